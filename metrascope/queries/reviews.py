"""Samples, agreement, calibration, labels and their roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import labels as B
from ..operators import replies as R
from .common import rate_sql, rounded, table, wilson_sql


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the two labels of a document, as if two people had given them."""
    return rounded(A.agreement(table(spark, sf_dir, "labels"), "quality", "toxic"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.calibration(table(spark, sf_dir, "labels"), F.col("quality") == 0, F.col("toxic") == 1))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return rounded(A.stratified_sample(docs, "lang", "doc_id", {"en": 20, "fr": 20, "de": 20, "es": 15}, 42))


def first_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two turns of each conversation as verdicts."""
    return A.first_two(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "role")


def vignette_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events are all of one type, or all of the month's first value."""
    events = table(spark, sf_dir, "events").select(F.col("user_id") * 100 + F.floor("value") % 100, "event_type", F.floor(F.col("value") / 10).alias("tens")).toDF("item", "event_type", "tens")
    return A.stability(events.withColumn("wanted", F.lit("view")), "item", ["event_type", "tens"], {"event_type": "wanted"})


_POLARITY = "CASE WHEN {k} % 5 = 0 THEN 'author_use' WHEN {k} % 5 = 1 THEN 'non_use_statement' WHEN {k} % 5 = 2 THEN 'topic_only' WHEN {k} % 5 = 3 THEN 'unclear' ELSE 'false_positive' END"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as snippet labels of orders."""
    k, part = F.col("l_suppkey"), F.col("l_partkey")
    one = lambda c: F.array(c.cast("string"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("line"), F.min("l_returnflag").alias("flag"))
    return items.select(
        F.col("l_orderkey").alias("arxiv_id"), (part * 10_000 + k).alias("id"), F.expr(_POLARITY.format(k="l_suppkey")).alias("polarity"),
        F.element_at(F.array(*[F.lit(x) for x in B.IMPACTS]), (part % 5 + 1).cast("int")).alias("impact"), one(part % 3).alias("tools"), one(part % 2).alias("models"),
        one(part % 4).alias("categories"), F.when(part % 7 != 0, F.concat(F.lit("loc"), (part % 2).cast("string"))).alias("location"),
        F.create_map(F.lit("catalytic"), part % 11 == 0, F.lit("method_component"), part % 13 == 0).alias("flags"),
        (part % 3 != 0).cast("int").alias("quote_grounded"), F.when(part % 4 == 0, "unchecked").otherwise("rendered").alias("render_status"), F.when(part % 8 == 0, "meta:comments").otherwise("tex").alias("source_kind"))


def label_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = B.roll_up(_items(spark, sf_dir), grounded=True, rendered=True)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return told.select("arxiv_id", "polarity", joined("tools"), joined("categories"), joined("locations"), "impact", joined("impacts_seen"), F.element_at("flags", "catalytic").alias("catalytic"), F.element_at("flags", "method_component").alias("method_component"), "has_contributing_use", "has_zero_contribution_attempt", "ungated")


def label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by overlapping states of use."""
    told = B.roll_up(_items(spark, sf_dir)).where("polarity = 'author_use'")
    return told.agg(F.count(F.lit(1)).alias("n"), F.count_if("has_contributing_use").alias("contributing"), F.count_if("has_zero_contribution_attempt").alias("zero"), F.count_if("has_undetermined_impact").alias("undetermined"))


def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to refuse labels written from the label table, with faults by document id."""
    k = F.col("doc_id") % 9
    names = ("polarity", "tools", "models", "categories", "epistemic_impact", "locations", "confidence", "quote", "flags")
    values = {
        "polarity": F.when(k == 1, '"maybe"').otherwise('"author_use"'), "tools": F.lit('["GPT"]'), "models": F.lit("[]"),
        "categories": F.when(k == 2, '["sculpture"]').otherwise('["ideation"]'), "epistemic_impact": F.when(k == 3, '"not_applicable"').when(k == 4, '"zero_contribution"').otherwise('"supportive"'),
        "locations": F.when(k == 5, "[]").otherwise('["body"]'), "confidence": F.when(k == 6, "true").when(k == 7, "5").otherwise("0.5"), "quote": F.when(k == 8, '""').otherwise('"we asked it"'),
        "flags": F.when(k == 4, '{"catalytic": true}').otherwise('{"catalytic": false}'),
    }
    text = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), values[n]) for n in names]), F.lit("}"))
    rows = table(spark, sf_dir, "labels").select("doc_id", text.alias("label_json"), F.lit("then we  asked it twice").alias("snippet"))
    told = B.validate_labels(rows)
    return told.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label.quote_grounded")).alias("grounded"))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as what reviewers say of papers."""
    said = F.when(F.col("doc_id") % 7 == 0, "UNCLEAR").when(F.col("doc_id") % 11 == 0, "INSUFFICIENT_EVIDENCE").when(F.col("toxic") == 1, "TRUE_DISCLOSURE").otherwise("TOPIC_ONLY")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("arxiv_id"), said.alias("verdict"), F.when((F.col("quality") == 0) | (F.col("doc_id") % 3 == 1), "author_use").otherwise("topic_only").alias("polarity"))


def calibration_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine against reviewers by stratum, with plants, exclusions and papers that the machine never saw."""
    rows, key = _verdicts(spark, sf_dir), F.col("arxiv_id")
    frame = rows.select("arxiv_id", F.element_at(F.array(F.lit("POS"), F.lit("FLAG"), F.lit("NEG")), (key % 3 + 1).cast("int")).alias("stratum"), (key % 2 == 0).alias("plant"))
    return A.stratified_calibration(rows.select("arxiv_id", "verdict"), frame, rows.where(key % 5 != 4), rows.where(key % 4 != 0), rows.where(key % 13 == 0).select("arxiv_id", F.lit("duplicate").alias("reason")))


def planted_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten papers to show again, none among the first fifty of either reviewer."""
    rows, key = table(spark, sf_dir, "labels"), F.col("doc_id")
    frame = rows.select("doc_id", F.element_at(F.array(F.lit("POS"), F.lit("FLAG"), F.lit("NEG")), (key % 3 + 1).cast("int")).alias("stratum"))
    orders = rows.select("doc_id", F.inline(F.array(F.struct(F.lit("a").alias("reviewer"), key.alias("place")), F.struct(F.lit("b").alias("reviewer"), F.abs(key - 100).alias("place")))))
    return A.plant(frame, orders, 10, 50, 7, "doc_id")


def vignette_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers under blind ids, joined with their keys and held against what is expected, axis by axis."""
    labels = table(spark, sf_dir, "labels")
    blind = F.concat(F.lit("item-"), (F.col("doc_id") * 7).cast("string"))
    answers = labels.select(F.lit("a").alias("reviewer"), blind.alias("blind_id"), F.col("quality").alias("polarity"), F.col("toxic").alias("flag"), (F.col("doc_id") % 4).alias("impact"))
    mapping = labels.select(F.lit("a").alias("reviewer"), blind.alias("blind_id"), F.col("doc_id").alias("key"))
    expected = labels.select(F.col("doc_id").alias("key"), F.lit(1).alias("polarity"), F.lit(0).alias("flag"), (F.col("doc_id") % 3).alias("impact"))
    return A.axis_summary(A.unblinded(answers, mapping), expected, "key", ["polarity", "flag", "impact"])


def certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with items of use by the best of these items' render states."""
    states = F.array(*[F.lit(x) for x in (*B.RENDER_RANK, "unchecked")])
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("arxiv_id"), F.when(F.col("l_partkey") % 5 == 0, "error:x").otherwise("ok").alias("status"), F.expr(_POLARITY.format(k="l_suppkey")).alias("polarity"),
        F.element_at(states, (F.col("l_partkey") % 8 + 1).cast("int")).alias("render_status"))
    papers = items.where("status = 'ok' AND polarity = 'author_use'").select("arxiv_id").distinct()
    return B.certification(papers, items).groupBy("certification").agg(F.count(F.lit(1)).alias("n"))


def settled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as snippets of conversations; replies that are errors, incomplete or missing leave error rows."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("batch"), (F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("place"))
    sizes = turns.groupBy("batch").agg(F.count(F.lit(1)).cast("int").alias("n")).where("batch % 5 <> 4")
    ids = F.sequence(F.lit(0), F.col("n") - F.when(F.col("batch") % 5 == 1, 2).otherwise(1))
    ids = F.when((F.col("batch") % 5 == 1) & (F.col("n") < 2), F.expr("CAST(array() AS ARRAY<INT>)")).otherwise(ids)
    replies = sizes.select("batch", F.when(F.col("batch") % 5 == 2, "Timeout: late").alias("error"), F.reverse(ids).alias("ids"), F.reverse(F.transform(ids, lambda i: F.concat(F.lit("label "), i.cast("string")))).alias("labels"))
    return B.settle_batches(turns, replies).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label_json") == F.concat(F.lit("label "), F.col("place").cast("string"))).alias("labelled"))


def evidence_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from items to hits, and the items that rest on hits of one scan run."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("long")).alias("hit_ids"))
    hits = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), F.concat(F.lit("run"), (F.col("p_partkey") % 40).cast("string")).alias("scan_run"))
    return B.eligible_items(B.evidence_edges(items), hits, "run3")


def verdict_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons to refuse exported verdicts, with faults by document id."""
    k = F.col("doc_id") % 12
    parts = {
        "arxiv_id": F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"')), "version": F.lit("1"),
        "verdict": F.when(k == 1, '"MAYBE"').when(k.isin(8, 9, 10), '"TOPIC_ONLY"').otherwise('"TRUE_DISCLOSURE"'), "categories": F.when(k == 2, '["sculpture"]').when(k == 3, "[]").otherwise('["ideation"]'),
        "impact": F.when(k == 4, '"not_applicable"').otherwise('"cosmetic"'), "flags": F.when(k.isin(5, 9), '["catalytic"]').when(k == 6, '["magic"]').otherwise("[]"),
        "tools": F.lit('"GPT"'), "locations": F.when(k == 7, "[]").when(k == 10, '["attic"]').otherwise('["body"]'), "notes": F.lit('""'),
    }
    more = F.when(k == 11, ', "r5_states": null').otherwise("")
    text = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), v) for n, v in parts.items()]), more, F.lit("}"))
    told = R.validate_verdicts(table(spark, sf_dir, "labels").select("doc_id", text.alias("item_json")))
    return told.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("verdict.categories") > 0).alias("with_categories"), F.count_if(F.size("verdict.locations") > 0).alias("with_places"))


def usage_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by provider from usage objects, some of them missing parts or contradictory."""
    k, n = F.col("l_partkey") % 3, F.col("l_quantity").cast("long").cast("string")
    cached = F.when(F.col("l_suppkey") % 5 == 0, "1000").when(F.col("l_suppkey") % 5 == 1, "true").otherwise("1")
    text = F.when(k == 0, F.concat(F.lit('{"prompt_tokens": '), n, F.lit(', "completion_tokens": 2, "prompt_tokens_details": {"cached_tokens": '), cached, F.lit("}}")))
    text = text.when(k == 1, F.concat(F.lit('{"input_tokens": '), n, F.lit(', "output_tokens": 3, "cache_read_input_tokens": '), cached, F.lit("}")))
    text = text.otherwise(F.when(F.col("l_suppkey") % 5 == 2, F.concat(F.lit('{"promptTokenCount": '), n, F.lit("}"))).otherwise(F.concat(F.lit('{"promptTokenCount": '), n, F.lit(', "candidatesTokenCount": 4}'))))
    provider = F.element_at(F.array(F.lit("openai"), F.lit("anthropic"), F.lit("google")), (k + 1).cast("int"))
    told = table(spark, sf_dir, "lineitem").select(provider.alias("provider"), R.usage_classes(provider, text).alias("u"))
    return told.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count("u").alias("usable"), *[F.sum(f"u.{c}").alias(c) for c in ("input", "cached_input", "cache_write", "output")])


def replies_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with fences, talk around them, faults and control characters."""
    k = (F.col("doc_id") % 6).cast("int")
    texts = ['[{"id": 0}]', '```json\n[{"id": 0}]\n```', 'Here: [1, 2] done', '[{"q": "\\\\beta and \\neta"}]', '[{"id": 0}', '[{"q": "a \\\\nabla"}]']
    value, problem = R.json_array(F.element_at(F.array(*[F.lit(x) for x in texts]), k + 1))
    told = table(spark, sf_dir, "labels").select(F.coalesce(problem, F.lit("ok")).alias("problem"), value.isNotNull().alias("parsed"))
    return told.groupBy("problem", "parsed").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (kappa, calibration, stratified_sample, first_reviews, vignette_stability, label_rollup, label_states, label_validation, calibration_by_stratum, planted_again, vignette_axes, certified, settled_batches, evidence_of_run, verdict_validation, usage_by_class, replies_parsed)}
_ITEMS = f"""WITH i AS (SELECT DISTINCT l_orderkey AS arxiv_id, l_suppkey, l_partkey AS part, l_partkey * 10000 + l_suppkey AS id, {_POLARITY.format(k="l_suppkey")} AS polarity,
    CASE l_partkey % 5 WHEN 0 THEN 'cosmetic' WHEN 1 THEN 'supportive' WHEN 2 THEN 'result_bearing' WHEN 3 THEN 'zero_contribution' ELSE 'undetermined' END AS impact,
    CASE l_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 5 WHEN 2 THEN 6 WHEN 3 THEN 2 ELSE 3 END AS weight,
    CASE l_suppkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END AS rank FROM lineitem)"""
ORACLE_SQL = {
    "kappa": """WITH c AS (SELECT quality AS a, toxic AS b, CAST(count(*) AS DOUBLE) AS m FROM labels GROUP BY 1, 2), t AS (SELECT sum(m) AS n, sum(CASE WHEN a = b THEN m ELSE 0 END) / sum(m) AS po FROM c),
        e AS (SELECT sum(x.m * y.m) AS met FROM (SELECT a, sum(m) AS m FROM c GROUP BY 1) x JOIN (SELECT b, sum(m) AS m FROM c GROUP BY 1) y ON a = b)
        SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS agree, round((po - coalesce(met, 0) / (n * n)) / (1 - coalesce(met, 0) / (n * n)), 6) AS kappa FROM t, e""",
    "calibration": f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS shown, count(*) FILTER (toxic = 1 AND quality = 0) AS confirmed, count(*) FILTER (quality = 0) AS hp,
        count(*) FILTER ((quality = 0) = (toxic = 1)) AS same FROM labels)
        SELECT n, shown, confirmed, round(CAST(confirmed AS DOUBLE) / nullif(shown, 0), 6) AS precision, round({wilson_sql('confirmed', 'shown', '-')}, 6) AS precision_lo,
        round({wilson_sql('confirmed', 'shown', '+')}, 6) AS precision_hi, round(CAST(confirmed AS DOUBLE) / nullif(hp, 0), 6) AS recall, round(CAST(same AS DOUBLE) / n, 6) AS concordance FROM c""",
    "stratified_sample": """WITH w(lang, w) AS (VALUES ('en', 20), ('fr', 20), ('de', 20), ('es', 15)), k AS (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS frame_n,
        row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS k FROM documents)
        SELECT lang, doc_id, frame_n, CAST(least(w, frame_n) AS BIGINT) AS n, round(CAST(least(w, frame_n) AS DOUBLE) / frame_n, 6) AS inclusion_p FROM k JOIN w USING (lang) WHERE k <= w""",
    "first_reviews": """WITH k AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS k FROM conversations)
        SELECT conv_id, max(role) FILTER (k = 1) AS a, max(role) FILTER (k = 2) AS b FROM k GROUP BY 1 HAVING count(*) >= 2""",
    "vignette_stability": """WITH e AS (SELECT user_id * 100 + CAST(floor(value) AS BIGINT) % 100 AS item, event_type, CAST(floor(value / 10) AS BIGINT) AS tens FROM events)
        SELECT item, count(DISTINCT event_type) = 1 AS event_type_stable, count(DISTINCT tens) = 1 AS tens_stable, bool_and(event_type = 'view') AS event_type_expected,
        count(DISTINCT event_type) = 1 AND count(DISTINCT tens) = 1 AS all_stable FROM e GROUP BY 1""",
    "label_rollup": _ITEMS + """, g AS (SELECT *, polarity <> 'author_use' OR (part % 3 <> 0 AND (part % 4 <> 0 OR part % 8 = 0)) AS ok FROM i), u AS (SELECT *, ok AND polarity = 'author_use' AS used FROM g)
        SELECT arxiv_id, arg_max(polarity, rank * 1000000000000 - id) FILTER (ok) AS polarity, coalesce(string_agg(DISTINCT CAST(part % 3 AS VARCHAR), ',' ORDER BY CAST(part % 3 AS VARCHAR)) FILTER (used), '') AS tools,
        coalesce(string_agg(DISTINCT CAST(part % 4 AS VARCHAR), ',' ORDER BY CAST(part % 4 AS VARCHAR)) FILTER (used), '') AS categories,
        coalesce(string_agg(DISTINCT CASE WHEN part % 7 = 0 THEN 'unknown' ELSE 'loc' || part % 2 END, ',' ORDER BY CASE WHEN part % 7 = 0 THEN 'unknown' ELSE 'loc' || part % 2 END) FILTER (used), '') AS locations,
        arg_max(impact, weight * 1000000000000 - id) FILTER (used) AS impact, coalesce(string_agg(DISTINCT impact, ',' ORDER BY impact) FILTER (used), '') AS impacts_seen,
        count(*) FILTER (used AND part % 11 = 0) > 0 AS catalytic, count(*) FILTER (ok AND part % 13 = 0) > 0 AS method_component, count(*) FILTER (used AND weight >= 4) > 0 AS has_contributing_use,
        count(*) FILTER (used AND weight = 2) > 0 AS has_zero_contribution_attempt, count(*) FILTER (NOT ok) > 0 AND count(*) FILTER (used) = 0 AS ungated FROM u GROUP BY 1""",
    "label_states": _ITEMS + """, p AS (SELECT arxiv_id, bool_or(weight >= 4) AS c, bool_or(weight = 2) AS z, bool_or(weight = 3) AS u FROM i WHERE polarity = 'author_use' GROUP BY 1)
        SELECT count(*) AS n, count(*) FILTER (c) AS contributing, count(*) FILTER (z) AS zero, count(*) FILTER (u) AS undetermined FROM p""",
    "calibration_by_stratum": f"""WITH v AS (SELECT doc_id AS d, doc_id % 13 = 0 AS x, doc_id % 7 = 0 OR doc_id % 11 = 0 AS silent, doc_id % 3 AS s, doc_id % 2 = 0 AS plant,
            toxic = 1 AND NOT (doc_id % 7 = 0 OR doc_id % 11 = 0) AS t, (quality = 0 OR doc_id % 3 = 1) AND doc_id % 5 <> 4 AS u, doc_id % 4 <> 0 AS seen FROM labels),
        m(measure, n, k) AS (
            SELECT 'pos_shown', count(*) FILTER (c AND s = 0 AND NOT plant), count(*) FILTER (c AND s = 0 AND NOT plant AND t) FROM (SELECT *, NOT x AND NOT silent AS c FROM v)
            UNION ALL SELECT 'pos_plants', count(*) FILTER (c AND plant AND u), count(*) FILTER (c AND plant AND u AND t) FROM (SELECT *, NOT x AND NOT silent AS c FROM v)
            UNION ALL SELECT 'flag', count(*) FILTER (c AND s = 1 AND NOT plant), count(*) FILTER (c AND s = 1 AND NOT plant AND t) FROM (SELECT *, NOT x AND NOT silent AS c FROM v)
            UNION ALL SELECT 'neg', count(*) FILTER (c AND s = 2), count(*) FILTER (c AND s = 2 AND t) FROM (SELECT *, NOT x AND NOT silent AS c FROM v)
            UNION ALL SELECT 'agreement', count(*) FILTER (c), count(*) FILTER (c AND t = u) FROM (SELECT *, NOT x AND NOT silent AS c FROM v)
            UNION ALL SELECT 'agreement_seen', count(*) FILTER (c AND seen), count(*) FILTER (c AND seen AND t = u) FROM (SELECT *, NOT x AND NOT silent AS c FROM v)
            UNION ALL SELECT 'agreement_unseen', count(*) FILTER (c AND NOT seen), count(*) FILTER (c AND NOT seen AND t = u) FROM (SELECT *, NOT x AND NOT silent AS c FROM v)
            UNION ALL SELECT 'not_evaluable', count(*) FILTER (silent AND NOT x), 0 FROM v UNION ALL SELECT 'excluded', count(*) FILTER (x), 0 FROM v)
        SELECT measure, {rate_sql('m.k', 'm.n')} FROM m""",
    "planted_again": "SELECT doc_id FROM labels WHERE doc_id % 3 < 2 AND doc_id >= 50 AND abs(doc_id - 100) >= 50 ORDER BY md5('7-plants|' || doc_id), doc_id LIMIT 10",
    "vignette_axes": """WITH a AS (SELECT quality = 1 AS p, toxic = 0 AS f, doc_id % 4 = doc_id % 3 AS i FROM labels)
        SELECT 'polarity' AS axis, count(*) AS n, count(*) FILTER (p) AS k FROM a UNION ALL SELECT 'flag', count(*), count(*) FILTER (f) FROM a
        UNION ALL SELECT 'impact', count(*), count(*) FILTER (i) FROM a UNION ALL SELECT 'all', count(*), count(*) FILTER (p AND f AND i) FROM a""",
    "certified": """WITH i AS (SELECT l_orderkey AS o, max(CASE l_partkey % 8 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 0 END) AS r
            FROM lineitem WHERE l_partkey % 5 <> 0 AND l_suppkey % 5 = 0 GROUP BY 1)
        SELECT CASE r WHEN 5 THEN 'certified' WHEN 4 THEN 'fuzzy' WHEN 3 THEN 'no_match' WHEN 2 THEN 'no_text' ELSE 'unknown' END AS certification, count(*) AS n FROM i GROUP BY 1""",
    "settled_batches": """WITH t AS (SELECT conv_id AS b FROM conversations),
        s AS (SELECT CASE WHEN b % 5 = 4 THEN 'error:no reply' WHEN b % 5 = 2 THEN 'error:Timeout: late' WHEN b % 5 = 1 THEN 'error:ids are not those asked for' ELSE 'ok' END AS status FROM t)
        SELECT status, count(*) AS n, count(*) FILTER (status = 'ok') AS labelled FROM s GROUP BY 1""",
    "evidence_of_run": "SELECT DISTINCT l_orderkey AS classification_item_id FROM lineitem WHERE l_partkey % 40 = 3 AND l_partkey IN (SELECT p_partkey FROM part)",
    "verdict_validation": """WITH r AS (SELECT doc_id % 12 AS k, CASE doc_id % 12 WHEN 1 THEN 'unknown verdict' WHEN 2 THEN 'unknown categories sculpture' WHEN 3 THEN 'a disclosure needs a category' WHEN 4 THEN 'a disclosure needs an impact'
        WHEN 5 THEN 'catalytic implies at least supportive' WHEN 6 THEN 'unknown flags magic' WHEN 7 THEN 'a disclosure needs a location' WHEN 9 THEN 'catalytic requires author_use' WHEN 10 THEN 'unknown locations attic'
        WHEN 11 THEN 'fields of an older codebook r5_states' ELSE 'ok' END AS reason FROM labels)
        SELECT reason, count(*) AS n, count(*) FILTER (k = 0) AS with_categories, count(*) FILTER (reason = 'ok') AS with_places FROM r GROUP BY 1""",
    "usage_by_class": """WITH r AS (SELECT l_partkey % 3 AS k, l_suppkey % 5 AS f, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
        u AS (SELECT *, CASE k WHEN 0 THEN f >= 2 AND q >= 1 WHEN 1 THEN f <> 1 ELSE f <> 2 AND q > 0 END AS fine, CASE WHEN k = 2 THEN 0 WHEN f = 0 THEN 1000 ELSE 1 END AS c FROM r)
        SELECT CASE k WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'google' END AS provider, count(*) AS n, count(*) FILTER (fine) AS usable,
            CAST(sum(CASE WHEN k = 0 THEN q - c ELSE q END) FILTER (fine) AS BIGINT) AS input, CAST(sum(c) FILTER (fine) AS BIGINT) AS cached_input, CAST(sum(0) FILTER (fine) AS BIGINT) AS cache_write,
            CAST(sum(k + 2) FILTER (fine) AS BIGINT) AS output FROM u GROUP BY k""",
    "replies_parsed": """SELECT CASE doc_id % 6 WHEN 3 THEN 'control character in a string' WHEN 4 THEN 'no JSON array found' ELSE 'ok' END AS problem, doc_id % 6 NOT IN (3, 4) AS parsed, count(*) AS n FROM labels GROUP BY 1, 2""",
    "label_validation": """WITH r AS (SELECT CASE doc_id % 9 WHEN 1 THEN 'bad polarity' WHEN 2 THEN 'unknown categories' WHEN 3 THEN 'author_use cannot be not_applicable' WHEN 4 THEN 'zero_contribution contradicts catalytic'
        WHEN 5 THEN 'locations must be a non-empty list' WHEN 6 THEN 'confidence must be a number' WHEN 7 THEN 'confidence out of range' WHEN 8 THEN 'missing quote for author_use' ELSE 'ok' END AS reason FROM labels)
        SELECT reason, count(*) AS n, count(*) FILTER (reason = 'ok') AS grounded FROM r GROUP BY 1""",
}
