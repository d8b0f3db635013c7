"""Replies of people and models: strict JSON, verdicts of reviewers, usage by billing class.

All are expressions over variants: types are told apart, what is unknown is
refused, and nothing is repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agreement import TRUE
from .labels import CATEGORIES, FLAGS, IMPACTS, LOCATIONS, cross_field_problem

# Verdicts, keys of an exported item, keys that mark an older codebook, verdicts whose statement has a place, limits.
VERDICTS = (TRUE, "NON_USE_STATEMENT", "TOPIC_ONLY", "FALSE_POSITIVE", "NO_AI_MENTION", "UNCLEAR", "INSUFFICIENT_EVIDENCE")
ITEM_KEYS = ("arxiv_id", "version", "verdict", "categories", "impact", "flags", "tools", "locations", "notes")
LEGACY_KEYS = ("method_component", "external_ai_artifact", "r5_states", "has_explicit_zero_attempt", "has_undetermined_use")
PLACED = ("TOPIC_ONLY", "NON_USE_STATEMENT", "FALSE_POSITIVE", "UNCLEAR")
MOST_TOOLS, MOST_NOTES = 300, 2000
# A line that opens or closes a fence; control characters, as JSON text may hold them or write them.
FENCE = r"(?m)^```(?:json)?|```$"
CONTROL, WRITTEN_CONTROL = r"[\x00-\x1f]", r"(?<!\\)(?:\\\\)*\\(?:[bfnrt]|u00[01])"


def json_array(reply: Column) -> tuple[Column, Column]:
    """(variant, problem) of the array in a reply: fences go, and control characters inside strings are refused.

    Such characters are what TeX commands turn into when their backslashes are
    not escaped. White space between values is no string.
    """
    bare = F.regexp_replace(F.trim(reply), FENCE, "")
    text = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    strings = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]|\\.)*"'), F.lit(0))
    hidden = F.exists(strings, lambda s: s.rlike(CONTROL) | s.rlike(WRITTEN_CONTROL))
    value = F.try_parse_json(text)
    array = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    problem = F.when(reply.isNull() | (text == ""), "no JSON array found").when(hidden, "control character in a string").when(value.isNull() | ~array, "malformed JSON")
    return F.when(problem.isNull(), value), problem


def validate_verdicts(rows: DataFrame, json_col: str = "item_json") -> DataFrame:
    """``rows`` with reason (null if valid) and the clean verdict of an exported item.

    Usage is kept for true disclosures only, places for verdicts about a
    statement; fields of an older codebook are refused even if empty.
    """
    v = F.try_parse_json(F.col(json_col))
    rows = rows.withColumn("_v", v).withColumn("_object", F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)))
    keys = F.map_keys(F.when(F.col("_object"), F.col("_v").cast("map<string,variant>")))
    text = lambda k: F.try_variant_get("_v", f"$.{k}", "string")
    texts = lambda k: F.array_sort(F.coalesce(F.try_variant_get("_v", f"$.{k}", "array<string>"), F.expr("CAST(array() AS ARRAY<STRING>)")))
    rows = rows.withColumns({"_keys": keys, "_verdict": text("verdict"), "_impact": F.coalesce(text("impact"), F.lit("")), "_tools": F.left(F.coalesce(text("tools"), F.lit("")), F.lit(MOST_TOOLS)), **{f"_{k}": texts(k) for k in ("categories", "locations", "flags")}})
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    among = lambda c, xs: F.array_sort(F.array_intersect(c, listed(xs)))
    beyond = lambda c, xs: F.array_sort(F.array_except(c, listed(xs)))
    some = lambda a, what: F.when(F.size(a) > 0, F.concat(F.lit(f"{what} "), F.array_join(a, ",")))
    true, catalytic = F.col("_verdict") == TRUE, F.array_contains("_flags", "catalytic")
    allowed = [x for x in IMPACTS if x != "not_applicable"]
    rows = rows.withColumn("reason", F.coalesce(
        F.when(~F.col("_object"), F.lit("not an object")),
        F.when(~F.coalesce(F.col("_verdict").isin(*VERDICTS), F.lit(False)), F.lit("unknown verdict")),
        some(among(F.col("_keys"), LEGACY_KEYS), "fields of an older codebook"),
        some(beyond(F.col("_keys"), ITEM_KEYS), "unknown keys"),
        some(beyond(F.col("_flags"), FLAGS), "unknown flags"),
        F.when(true, some(beyond(F.col("_categories"), CATEGORIES), "unknown categories")),
        some(beyond(F.col("_locations"), LOCATIONS), "unknown locations"),
        F.when(true & ~F.col("_impact").isin(*allowed), F.lit("a disclosure needs an impact")),
        F.when(true & (F.size("_categories") == 0), F.lit("a disclosure needs a category")),
        F.when(true & (F.size("_locations") == 0), F.lit("a disclosure needs a location")),
        cross_field_problem(true, F.when(true, F.col("_impact")).otherwise("not_applicable"), catalytic)))
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    clean = F.struct(
        text("arxiv_id").alias("arxiv_id"), F.try_variant_get("_v", "$.version", "int").alias("version"), F.col("_verdict").alias("verdict"),
        F.when(true, F.col("_categories")).otherwise(empty).alias("categories"), F.when(true, F.col("_impact")).otherwise("not_applicable").alias("impact"),
        F.when(true, F.array_distinct("_flags")).otherwise(empty).alias("flags"), F.when(true, F.col("_tools")).otherwise("").alias("tools"),
        F.when(true | F.col("_verdict").isin(*PLACED), F.col("_locations")).otherwise(empty).alias("locations"), F.left(F.coalesce(text("notes"), F.lit("")), F.lit(MOST_NOTES)).alias("notes"))
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.select(*kept, F.when(F.col("reason").isNull(), clean).alias("verdict"))


# Where providers tell of tokens: input, output, those read from and written to a cache (paths in the
# usage object), and whether input includes the latter. A provider whose input includes them never reports none.
USAGE = {
    "openai": ("$.prompt_tokens", "$.completion_tokens", "$.prompt_tokens_details.cached_tokens", "$.prompt_tokens_details.cache_write_tokens", True),
    "anthropic": ("$.input_tokens", "$.output_tokens", "$.cache_read_input_tokens", "$.cache_creation_input_tokens", False),
    "google": ("$.promptTokenCount", "$.candidatesTokenCount", "$.cachedContentTokenCount", None, True),
}


def usage_classes(provider: Column, usage: Column) -> Column:
    """struct<input, cached_input, cache_write, output> of a usage object in JSON; null where it is missing, malformed or contradicts itself."""
    v = F.try_parse_json(usage)

    def tokens(path: str | None, needed: bool) -> Column:
        """The number at a path, -1 if there is something else."""
        if path is None:
            return F.lit(0).cast("long")
        held = F.try_variant_get(v, path, "variant")
        whole = F.when(F.schema_of_variant(held) == "BIGINT", F.try_variant_get(v, path, "long"))
        return F.when(held.isNull() & F.lit(not needed), F.lit(0).cast("long")).otherwise(F.coalesce(whole, F.lit(-1).cast("long")))

    out = F.lit(None).cast("struct<input: bigint, cached_input: bigint, cache_write: bigint, output: bigint>")
    for name, (given, made, cached, written, inside) in USAGE.items():
        i, o, r, w = tokens(given, True), tokens(made, True), tokens(cached, False), tokens(written, False)
        fine = (F.least(i, o, r, w) >= 0) & ((i > 0) & (r + w <= i) if inside else F.lit(True))
        told = F.struct((i - r - w if inside else i).alias("input"), r.alias("cached_input"), w.alias("cache_write"), o.alias("output"))
        out = F.when((provider == name) & F.coalesce(fine, F.lit(False)), told).when(provider == name, F.lit(None)).otherwise(out)
    return out
