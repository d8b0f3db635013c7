"""Labels under a closed schema: validation with reasons, and the roll-up of snippets to papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_grounded

# Vocabularies, ranks and limits of labels.
POLARITIES = ("author_use", "non_use_statement", "topic_only", "false_positive", "unclear")
POLARITY_RANK = {"author_use": 5, "non_use_statement": 4, "unclear": 3, "topic_only": 2, "false_positive": 1}
CATEGORIES = (
    "writing_editing", "proofreading", "literature_search", "ideation", "conjecture_generation", "examples_counterexamples",
    "proof_generation", "code_computation", "data_generation_labeling", "formalization", "figures", "unspecified",
)
IMPACTS = ("cosmetic", "supportive", "result_bearing", "zero_contribution", "undetermined", "not_applicable")
IMPACT_RANK = {"result_bearing": 6, "supportive": 5, "cosmetic": 4, "undetermined": 3, "zero_contribution": 2, "none": 1, "not_applicable": 0}
LOCATIONS = ("acknowledgments", "dedicated_section", "abstract", "comments_field", "footnote_thanks", "body", "ancillary_artifact", "unknown")
FLAGS = ("catalytic",)
KEYS = ("polarity", "tools", "models", "categories", "epistemic_impact", "locations", "confidence", "quote", "flags")
CONTRIBUTING = ("cosmetic", "supportive", "result_bearing")
DIAGNOSTICS = ("method_component", "external_ai_artifact")
MOST_ITEMS, MOST_CHARS, MOST_QUOTE = 20, 120, 600

LABEL = "polarity string, tools array<string>, models array<string>, categories array<string>, epistemic_impact string, locations array<string>, confidence double, quote string, flags map<string,boolean>"


#: Kinds of a label's keys that no vocabulary closes, and the vocabularies of the others.
TEXTS, CLOSED = ("tools", "models"), {"polarity": POLARITIES, "categories": CATEGORIES, "epistemic_impact": IMPACTS, "locations": LOCATIONS}


def label_schema(numbered: bool = True, closed: bool = True) -> dict:
    """The JSON schema of a label, made from the vocabularies; ``numbered``: with the number of its snippet, ``closed``: other keys are refused."""
    word = lambda k: {"type": "string", "enum": sorted(CLOSED[k]) if k != "locations" else list(LOCATIONS)}
    kinds = {
        "polarity": word("polarity"), **{k: {"type": "array", "items": {"type": "string"}} for k in TEXTS}, "categories": {"type": "array", "items": word("categories")},
        "epistemic_impact": word("epistemic_impact"), "locations": {"type": "array", "minItems": 1, "items": word("locations")}, "confidence": {"type": "number"}, "quote": {"type": "string"},
        "flags": {"type": "object", "properties": {f: {"type": "boolean"} for f in FLAGS}, "required": sorted(FLAGS)},
    }
    props = {**({"id": {"type": "integer"}} if numbered else {}), **{k: kinds[k] for k in KEYS}}
    told = {"type": "object", "properties": props, "required": list(props)}
    if closed:
        told["additionalProperties"] = kinds["flags"]["additionalProperties"] = False
    return told


def reply_schema(closed: bool = True) -> dict:
    """The JSON schema of a reply: an object with the labels."""
    told = {"type": "object", "properties": {"labels": {"type": "array", "items": label_schema(closed=closed)}}, "required": ["labels"]}
    return told | ({"additionalProperties": False} if closed else {})


def struct_of(schema: dict) -> T.DataType:
    """The Spark type of values that follow a JSON schema as these are."""
    kind = schema["type"]
    if kind == "array":
        return T.ArrayType(struct_of(schema["items"]))
    if kind == "object":
        return T.StructType([T.StructField(k, struct_of(v)) for k, v in schema["properties"].items()])
    return {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}[kind]


def read_replies(reply: Column) -> Column:
    """The labels of a reply as structs of the schema; null where it is no such object. What the types alone cannot tell, ``validate_labels`` does."""
    return F.from_json(reply, struct_of(reply_schema()))["labels"]


def cross_field_problem(author_use: Column, impact: Column, catalytic: Column) -> Column:
    """Why impact, flag and polarity contradict each other; null if they do not. One rule for people and machines."""
    return (
        F.when(author_use & (impact == "not_applicable"), "author_use cannot be not_applicable")
        .when(author_use & (impact == "zero_contribution") & catalytic, "zero_contribution contradicts catalytic")
        .when(author_use & catalytic & ~impact.isin("supportive", "result_bearing"), "catalytic implies at least supportive")
        .when(~author_use & catalytic, "catalytic requires author_use")
    )


def validate_labels(rows: DataFrame, json_col: str = "label_json", snippet_col: str = "snippet") -> DataFrame:
    """``rows`` with reason (null if valid), cleared (fields emptied because of the polarity) and the clean label.

    JSON is parsed as a variant: repeated keys are refused and types told apart
    (true is no number). Unknown and missing keys are refused, never defaulted.
    """
    v = F.try_parse_json(F.col(json_col))
    rows = rows.withColumn("_v", v).withColumn("_is_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    rows = rows.withColumn("_m", F.when(F.col("_is_object"), F.col("_v").cast("map<string,variant>")))
    keys, kind = F.map_keys("_m"), lambda k: F.coalesce(F.schema_of_variant(F.try_element_at("_m", F.lit(k))), F.lit("VOID"))
    known, texts = F.array(*[F.lit(k) for k in KEYS]), lambda k: F.when(kind(k) == "ARRAY<STRING>", F.try_variant_get("_v", f"$.{k}", "array<string>")).when(kind(k) == "ARRAY<VOID>", F.expr("CAST(array() AS ARRAY<STRING>)"))
    text = lambda k: F.when(kind(k) == "STRING", F.try_variant_get("_v", f"$.{k}", "string"))
    number = kind("confidence").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    flags = F.when(kind("flags").startswith("OBJECT"), F.try_variant_get("_v", "$.flags", "map<string,variant>"))
    rows = rows.withColumns({
        "_extra": F.array_sort(F.array_except(keys, known)), "_absent": F.array_except(known, keys),
        "_polarity": text("polarity"), "_impact": text("epistemic_impact"), "_quote": text("quote"),
        **{f"_{k}": texts(k) for k in ("tools", "models", "categories", "locations")},
        "_confidence": F.when(number, F.try_variant_get("_v", "$.confidence", "double")), "_flags": flags,
    })
    clean = lambda c: F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")))
    rows = rows.withColumns({f"_{k}": clean(F.col(f"_{k}")) if k != "locations" else F.array_sort(F.array_distinct("_locations")) for k in ("tools", "models", "categories", "locations")})
    use = F.col("_polarity") == "author_use"
    catalytic = F.coalesce(F.try_variant_get("_v", "$.flags.catalytic", "boolean"), F.lit(False))
    unbounded = [F.when(F.col(f"_{k}").isNull() | (F.size(f"_{k}") > MOST_ITEMS) | F.exists(f"_{k}", lambda x: F.length(x) > MOST_CHARS), F.lit(f"{k} is no bounded list of strings")) for k in ("tools", "models", "categories")]
    outside = lambda c, allowed: F.size(F.array_except(c, F.array(*[F.lit(x) for x in allowed]))) > 0
    flag_kinds = F.array_distinct(F.transform(F.map_values("_flags"), lambda x: F.schema_of_variant(x)))
    quoted = F.trim(F.col("_quote")) != ""
    reasons = [
        F.when(~F.col("_is_object"), F.lit("not an object")),
        F.when(F.size("_extra") > 0, F.concat(F.lit("unknown keys "), F.array_join("_extra", ","))),
        F.when(F.size("_absent") > 0, F.concat(F.lit("missing keys "), F.array_join("_absent", ","))),
        F.when(F.col("_polarity").isNull() | ~F.col("_polarity").isin(*POLARITIES), F.lit("bad polarity")),
        *unbounded,
        F.when(outside("_categories", CATEGORIES), F.lit("unknown categories")),
        F.when(F.col("_impact").isNull() | ~F.col("_impact").isin(*IMPACTS), F.lit("unknown impact")),
        F.when(F.col("_locations").isNull() | (F.size("_locations") == 0), F.lit("locations must be a non-empty list")),
        F.when(outside("_locations", LOCATIONS), F.lit("unknown locations")),
        F.when(F.col("_confidence").isNull(), F.lit("confidence must be a number")),
        F.when(F.isnan("_confidence") | ~F.col("_confidence").between(0, 1), F.lit("confidence out of range")),
        F.when(F.col("_quote").isNull(), F.lit("quote must be a string")),
        F.when(F.length("_quote") > MOST_QUOTE, F.lit("quote is too long")),
        F.when(F.col("_flags").isNull(), F.lit("flags must be an object")),
        F.when(outside(F.map_keys("_flags"), FLAGS), F.lit("unknown flags")),
        F.when(F.size("_flags") < len(FLAGS), F.lit("missing flags")),
        F.when(flag_kinds != F.array(F.lit("BOOLEAN")), F.lit("flags must be booleans")),
        F.when(use & ~quoted, F.lit("missing quote for author_use")),
        F.when(use & (F.size("_categories") == 0), F.lit("author_use needs a category")),
        F.when(F.col("_polarity").isin("non_use_statement", "unclear") & ~quoted, F.concat(F.lit("missing quote for "), F.col("_polarity"))),
        cross_field_problem(use, F.col("_impact"), catalytic),
    ]
    rows = rows.withColumn("reason", F.coalesce(*reasons))
    used = (F.size("_categories") > 0) | (F.col("_impact") != "not_applicable") | (F.size("_tools") > 0)
    empty, quote = F.expr("CAST(array() AS ARRAY<STRING>)"), F.trim(F.col("_quote"))
    label = F.struct(
        F.col("_polarity").alias("polarity"), F.when(use, F.col("_tools")).otherwise(empty).alias("tools"), F.col("_models").alias("models"),
        F.when(use, F.col("_categories")).otherwise(empty).alias("categories"), F.when(use, F.col("_impact")).otherwise("not_applicable").alias("epistemic_impact"),
        F.col("_locations").alias("locations"), F.col("_confidence").alias("confidence"), quote.alias("quote"),
        F.create_map(F.lit("catalytic"), use & catalytic).alias("flags"), is_grounded(quote, F.col(snippet_col)).alias("quote_grounded"))
    valid = F.col("reason").isNull()
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*kept, (valid & ~use & used).alias("cleared"), F.when(valid, label).alias("label"))


def reply_ids_complete(ids: Column, n: Column) -> Column:
    """Whether the ids of a reply are exactly 0 .. n-1."""
    return F.coalesce(F.array_sort(ids) == F.sequence(F.lit(0), n - 1), F.lit(False))


def passes_gates(grounded: bool, rendered: bool) -> Column:
    """Whether evidence of use counts; what stands in metadata needs no rendering."""
    ok = F.lit(True)
    if grounded:
        ok = ok & F.coalesce(F.col("quote_grounded") == 1, F.lit(False))
    if rendered:
        ok = ok & (F.coalesce(F.col("render_status") == "rendered", F.lit(False)) | F.coalesce(F.col("source_kind").startswith("meta:"), F.lit(False)))
    return ok


def roll_up(items: DataFrame, key: str = "arxiv_id", grounded: bool = False, rendered: bool = False) -> DataFrame:
    """One row per paper from valid items (id, polarity, impact, tools, models, categories, location, flags, gate columns).

    Items may have booleans has_explicit_zero_attempt and has_undetermined_use:
    states that one merged snippet carries beside its impact.

    The polarity of highest rank wins. Items of use that fail the gates do not
    count; papers left without use because of that are ``ungated``. Lists and
    impacts are merged over all items of use, the diagnostics of ``flags`` over
    all items. One aggregation by paper, in no particular order.
    """
    use = F.col("polarity") == "author_use"
    rank = F.create_map(*[x for p, r in POLARITY_RANK.items() for x in (F.lit(p), F.lit(r))])
    weight = F.create_map(*[x for p, r in IMPACT_RANK.items() for x in (F.lit(p), F.lit(r))])
    told = items.withColumn("_ok", ~use | passes_gates(grounded, rendered))
    counts, used = F.col("_ok"), F.col("_ok") & use
    merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(used, F.col(c))))))
    carried = lambda c: F.coalesce(F.bool_or(F.when(used, F.col(c))), F.lit(False)) if c in items.columns else F.lit(False)
    flag = lambda f, when: F.coalesce(F.bool_or(F.when(when, F.coalesce(F.try_element_at("flags", F.lit(f)), F.lit(False)))), F.lit(False))
    paper = told.groupBy(key).agg(
        F.max_by(F.when(counts, F.col("polarity")), F.when(counts, F.struct(F.coalesce(F.try_element_at(rank, F.col("polarity")), F.lit(0)), -F.col("id")))).alias("polarity"),
        merged("tools").alias("tools"), merged("models").alias("models"), merged("categories").alias("categories"),
        F.array_sort(F.collect_set(F.when(used, F.coalesce("location", F.lit("unknown"))))).alias("locations"),
        F.array_sort(F.collect_set(F.when(used, F.col("impact")))).alias("impacts_seen"),
        F.max_by(F.when(used, F.col("impact")), F.when(used, F.struct(F.coalesce(F.try_element_at(weight, F.col("impact")), F.lit(0)), -F.col("id")))).alias("impact"),
        F.map_from_arrays(F.array(*[F.lit(f) for f in (*FLAGS, *DIAGNOSTICS)]), F.array(*[flag(f, used) for f in FLAGS], *[flag(f, counts) for f in DIAGNOSTICS])).alias("flags"),
        F.bool_or(use & ~F.col("_ok")).alias("_failed"), carried("has_explicit_zero_attempt").alias("_zero"), carried("has_undetermined_use").alias("_open"))
    seen = F.col("impacts_seen")
    return paper.select(
        key, "polarity", "tools", "models", "categories", "locations", "impact", "impacts_seen", "flags",
        F.arrays_overlap(seen, F.array(*[F.lit(x) for x in CONTRIBUTING])).alias("has_contributing_use"),
        (F.array_contains(seen, "zero_contribution") | F.col("_zero")).alias("has_zero_contribution_attempt"),
        (F.array_contains(seen, "undetermined") | F.col("_open")).alias("has_undetermined_impact"),
        (F.col("_failed") & ~F.coalesce(F.col("polarity") == "author_use", F.lit(False))).alias("ungated"))


#: How far a rendered text bears out a quote, best first.
RENDER_RANK = {"rendered": 5, "rendered_fuzzy": 4, "non_rendered_evidence": 3, "quote_too_short": 3, "pdf_error": 2, "no_pdf": 2, "unknown_version": 1}
RENDER_GROUPS = {"rendered": "certified", "rendered_fuzzy": "fuzzy", "non_rendered_evidence": "no_match", "quote_too_short": "no_match", "pdf_error": "no_text", "no_pdf": "no_text"}


def certification(papers: DataFrame, items: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """``papers`` with render_status, the best of their valid items of use (of ties, the first by name), and the group it counts in."""
    rank = F.create_map(*[x for s, r in RENDER_RANK.items() for x in (F.lit(s), F.lit(r))])
    group = F.create_map(*[x for s, g in RENDER_GROUPS.items() for x in (F.lit(s), F.lit(g))])
    worth = F.try_element_at(rank, F.col("render_status"))
    best = items.where((F.col("status") == "ok") & (F.col("polarity") == "author_use") & worth.isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by("render_status", F.struct(-worth, F.col("render_status"))).alias("render_status"))
    told = papers.join(best, F.col(key) == F.col("_key"), "left").drop("_key")
    return told.withColumn("certification", F.coalesce(F.try_element_at(group, F.col("render_status")), F.lit("unknown")))


def evidence_edges(items: DataFrame) -> DataFrame:
    """(classification_item_id, scan_hit_id) of items (id, hit_ids), failed ones too: a failure keeps its lineage."""
    return items.select(F.col("id").alias("classification_item_id"), F.explode("hit_ids").alias("scan_hit_id")).distinct()


def settle_batches(snippets: DataFrame, replies: DataFrame) -> DataFrame:
    """``snippets`` (batch, place, ...) with status and label_json of their replies (batch, error, ids, labels).

    A batch counts as a whole: with an error, or ids other than 0 .. n-1, each
    of its snippets is kept as an error row, so that none is lost or repeated.
    """
    size = snippets.groupBy("batch").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    told = replies.join(size, "batch")
    status = F.when(F.col("error").isNotNull(), F.concat(F.lit("error:"), F.left("error", F.lit(200)))).when(~reply_ids_complete(F.col("ids"), F.col("_n")), F.lit("error:ids are not those asked for")).otherwise("ok")
    told = told.select("batch", status.alias("_status"), "ids", "labels")
    met = snippets.join(told, "batch", "left")
    own = F.get("labels", F.array_position("ids", F.col("place")).cast("int") - 1)
    status = F.coalesce("_status", F.lit("error:no reply"))
    return met.select(*snippets.columns, status.alias("status"), F.when(status == "ok", own).alias("label_json"))


def eligible_items(evidence: DataFrame, hits: DataFrame, run: str) -> DataFrame:
    """Items with evidence from hits of one scan run."""
    own = hits.where(F.col("scan_run") == run).select(F.col("id").alias("scan_hit_id"))
    return evidence.join(own, "scan_hit_id", "left_semi").select("classification_item_id").distinct()
