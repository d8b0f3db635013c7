"""Selections, reconciliations, coverage, runs and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import status_class
from ..functions.stats import cost, reservation, settlement
from ..operators import selection as S
from ..operators import sessions as W
from ..sources.sinks import upsert
from .common import rounded, table


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by state: labels are scans, of which toxic ones failed; even ids were fetched, every sixth without success."""
    docs = _frame(spark, sf_dir)
    items = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "error:Toxic").otherwise("ok").alias("status"))
    files = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "error:404").otherwise("ok:src").alias("status"))
    return S.coverage(docs, items, files, "doc_id").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def error_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("toxic") == 1, F.concat(F.lit("error:Toxic:"), F.col("doc_id").cast("string"))).when(F.col("quality") == 0, "incomplete:members-skipped").otherwise("ok")
    return table(spark, sf_dir, "labels").select(status_class(status).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def orders_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return S.without(orders.select("o_orderkey", "o_orderstatus"), items.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in English that no toxic label names."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return S.without(_frame(spark, sf_dir).where("lang = 'en'"), toxic, ["doc_id"]).select("doc_id")


def todo_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without an item that was returned."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return S.todo(table(spark, sf_dir, "orders").select("o_orderkey"), items, "o_orderkey", F.col("l_returnflag") == "R")


def refill_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with several items, none of them number 1 from an even supplier, that belong to building customers."""
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_suppkey")
    several = S.by_version_count(items, "o_orderkey", True)
    held = S.without(several, items.where("l_linenumber = 1 AND l_suppkey % 2 = 0"), ["o_orderkey"])
    wanted = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return S.among(held, wanted, ["o_orderkey"])


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems between labelled documents (expected) and documents whose id is not divisible by 7, some listed twice."""
    docs = _frame(spark, sf_dir).withColumn("part", F.col("doc_id") % 10)
    want = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") % 10).alias("part"))
    have = docs.where("doc_id % 7 <> 0").withColumn("part", F.when(F.col("doc_id") % 11 == 0, F.col("part") + 1).otherwise(F.col("part")))
    have = have.unionByName(have.where("doc_id % 13 = 0"))
    told = S.problem_report(S.reconcile(want, have, "doc_id", "part", docs.where("doc_id % 17 <> 0")), "doc_id")
    return told.select("problem", "n", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"))


def artifact_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as artifacts of orders: kind from the return flag, version from the line number (null for 3)."""
    items = table(spark, sf_dir, "lineitem")
    versions = items.select(F.col("l_orderkey").alias("arxiv_id")).where("l_linenumber <= 2")
    held = items.groupBy("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "pdf").otherwise("src").alias("kind")).agg(F.min("l_partkey").alias("id"))
    held = held.select(F.col("l_orderkey").alias("arxiv_id"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("version"), "kind", "id")
    return S.pick_artifacts(held, versions).select("arxiv_id", "kind", "basis", "id")


def version_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    version = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber"))
    basis = F.when(F.col("l_suppkey") % 4 == 0, "inferred-single-version").otherwise("explicit-v1")
    return table(spark, sf_dir, "lineitem").groupBy(S.version_stratum(version, basis).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def run_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    one, two = labels.where("doc_id % 5 <> 0").withColumn("p", F.col("toxic") == 1), labels.where("doc_id % 7 <> 0").withColumn("p", F.col("quality") == 0)
    return S.compare_runs(one, two, "doc_id", "p")


def membership_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return S.membership_hash(docs, F.col("doc_id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3))


def latest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return W.latest(events, ["user_id", "event_type"], F.col("event_id"))


def merged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after an update of every third."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return upsert(old, old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("UPDATED")), ["c_custkey"])


def settled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per user and type: the first that is ok (an even value), or the first."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(F.floor("value") % 2 == 0, "ok").otherwise("error").alias("status"))
    return W.settle(events, ["user_id", "event_type"], "status", "event_id")


def turn_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at most two hours apart."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    chained = W.gap_sessions(events, ["user_id"], "at", 7_200_000_000, "event_id")
    return chained.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most 30 events of a type."""
    told = W.batches(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], ["event_id"])
    return told.groupBy("event_type", "batch").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON text, by event type."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.count_distinct(k).alias("different"))


def spend_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by provider and open reservations, tokens being the digits of values."""
    tokens = F.create_map(F.lit("input"), F.floor(F.col("value") * 100).cast("long"), F.lit("output"), F.col("user_id"))
    rates = F.create_map(F.lit("input"), F.lit(3.0), F.lit("output"), F.lit(15.0))
    told = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(cost(tokens, rates)).alias("usd"), F.count_if(F.col("user_id") % 9 == 0).alias("open"))
    return rounded(told)


def fetch_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred orders to fetch: those with a returned item first, then by a seeded shuffle."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    flagged = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 7").select(F.col("l_orderkey").alias("o_orderkey"))
    return S.queue(orders, flagged, "o_orderkey", F.md5(F.concat(F.lit("42|"), F.col("o_orderkey").cast("string"))), limit=100)


def render_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose rendering is to be checked, by their state."""
    k = F.col("l_partkey")
    state = F.element_at(F.array(*[F.lit(x) for x in ("unchecked", "rendered", "pdf_error", "no_pdf")]), (k % 4 + 1).cast("int"))
    items = table(spark, sf_dir, "lineitem").select(F.when(k % 9 == 0, "error:x").otherwise("ok").alias("status"), F.when(F.col("l_suppkey") % 2 == 0, "author_use").otherwise("unclear").alias("polarity"), F.when(k % 5 != 0, "words").alias("quote"), state.alias("render_status"))
    told = [S.to_render(items, ["author_use"], redo).groupBy("render_status").agg(F.count(F.lit(1)).alias("n")).withColumn("redo", F.lit(redo)) for redo in (False, True)]
    return told[0].unionByName(told[1])


def verdict_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts by whether they were asked for and are new."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    told = S.ingested(labels, labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 6 = 1"), "doc_id")
    return told.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def paper_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as hits of a paper."""
    hits = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("status"), (F.col("event_id") % 5).cast("string").alias("term"), (F.col("event_id") % 3).cast("string").alias("source"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("snippet"))
    return S.hit_summary(hits, F.col("status") == "purchase", "user_id", F.col("event_id"))


def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests reserve at the worst rate, and what they count for once settled."""
    rates = F.create_map(*[x for k, v in (("input", 3.0), ("cached_input", 0.3), ("cache_write", 3.75), ("output", 15.0)) for x in (F.lit(k), F.lit(v))])
    events = table(spark, sf_dir, "events").withColumn("reserved", reservation(F.col("props"), rates, 100, 1000))
    status, actual = F.when(F.col("event_id") % 10 == 0, 429).otherwise(200), F.when(F.col("event_id") % 3 != 0, F.col("value") / 1e5)
    return rounded(events.groupBy("event_type").agg(F.sum("reserved").alias("reserved"), F.sum(settlement(status, F.col("reserved"), actual)).alias("settled")))


def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (coverage_states, error_breakdown, orders_without_items, negatives, todo_anti, refill_targets, reconcile, artifact_choice, version_strata, run_compare, membership_hash, latest_upsert, merged_customers, settled_results, turn_sessions, request_batches, json_props, spend_ledger, newest, fetch_queue, render_selection, verdict_ingest, paper_hits, reservations)}
ORACLE_SQL = {
    "coverage_states": """SELECT CASE WHEN toxic = 0 THEN 'scanned' WHEN toxic = 1 THEN 'scan_error' WHEN d.doc_id % 2 = 1 THEN 'unfetched' WHEN d.doc_id % 6 = 0 THEN 'fetch_failed'
        ELSE 'fetched_not_in_run' END AS state, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""",
    "error_breakdown": "SELECT CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'incomplete' ELSE 'ok' END AS status, count(*) AS n FROM labels GROUP BY 1",
    "orders_without_items": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "negatives": "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "todo_anti": "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE l_orderkey IS NULL",
    "refill_targets": """SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')
        GROUP BY 1 HAVING count(*) > 1 AND count(*) FILTER (l_linenumber = 1 AND l_suppkey % 2 = 0) = 0""",
    "reconcile": """WITH want AS (SELECT DISTINCT doc_id, doc_id % 10 AS part FROM labels),
        have AS (SELECT doc_id, doc_id % 10 + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS part, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS n FROM documents WHERE doc_id % 7 <> 0),
        m AS (SELECT coalesce(w.doc_id, h.doc_id) AS doc_id, w.part AS wp, h.part AS hp, n FROM want w FULL JOIN have h USING (doc_id)),
        p AS (SELECT 'missing' AS problem, doc_id FROM m WHERE n IS NULL UNION ALL SELECT 'extra', doc_id FROM m WHERE wp IS NULL UNION ALL SELECT 'duplicate', doc_id FROM m WHERE n > 1
              UNION ALL SELECT 'wrong_group', doc_id FROM m WHERE wp <> hp UNION ALL SELECT 'unknown', doc_id FROM m WHERE n IS NOT NULL AND doc_id % 17 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY doc_id) AS k FROM p)
        SELECT problem, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (k <= 50) AS sample FROM k GROUP BY 1""",
    "artifact_choice": """WITH v AS (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1 HAVING count(*) = 1),
        a AS (SELECT l_orderkey AS arxiv_id, CASE WHEN l_linenumber <> 3 THEN l_linenumber END AS version, CASE WHEN l_returnflag = 'R' THEN 'pdf' ELSE 'src' END AS kind, min(l_partkey) AS id
              FROM lineitem GROUP BY ALL),
        c AS (SELECT *, CASE WHEN version = 1 THEN 'explicit-v1' ELSE 'inferred-single-version' END AS basis FROM a
              WHERE version = 1 OR (version IS NULL AND arxiv_id IN (SELECT l_orderkey FROM v)))
        SELECT arxiv_id, kind, basis, id FROM c QUALIFY row_number() OVER (PARTITION BY arxiv_id ORDER BY kind = 'pdf', basis <> 'explicit-v1', id) = 1""",
    "version_strata": """SELECT CASE WHEN l_linenumber = 3 THEN 'unknown' WHEN l_linenumber <> 1 THEN 'later' WHEN l_suppkey % 4 = 0 THEN 'v1_inferred' ELSE 'v1' END AS stratum, count(*) AS n FROM lineitem GROUP BY 1""",
    "run_compare": """SELECT count(*) AS common, count(*) FILTER (toxic = 1) AS positive_one, count(*) FILTER (quality = 0) AS positive_two, count(*) FILTER (toxic = 1 AND quality = 0) AS both,
        count(*) FILTER (toxic = 1 AND quality <> 0) AS only_one, count(*) FILTER (toxic <> 1 AND quality = 0) AS only_two FROM labels WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0""",
    "membership_hash": """WITH l AS (SELECT doc_id || ':' || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE CAST(doc_id % 3 AS VARCHAR) END AS line FROM documents)
        SELECT count(*) AS n, sha256(string_agg(line, chr(10) ORDER BY line)) AS membership_sha256 FROM l""",
    "latest_upsert": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "merged_customers": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "settled_results": """WITH e AS (SELECT user_id, event_type, event_id, CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 'ok' ELSE 'error' END AS status FROM events)
        SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY status = 'ok' DESC, event_id) = 1""",
    "turn_sessions": """WITH o AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM o)
        SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2""",
    "request_batches": """WITH b AS (SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 30 AS batch FROM events)
        SELECT event_type, batch, count(*) AS n, min(event_id) AS first_event FROM b GROUP BY 1, 2""",
    "json_props": """WITH k AS (SELECT event_type, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events)
        SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS different FROM k GROUP BY 1""",
    "spend_ledger": """SELECT event_type, round(sum((CAST(floor(value * 100) AS BIGINT) * 3e0 + user_id * 15e0) / 1e6), 6) AS usd, count(*) FILTER (user_id % 9 = 0) AS open FROM events GROUP BY 1""",
    "fetch_queue": """WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7), md5('42|' || o_orderkey), o_orderkey) AS place FROM orders)
        SELECT * FROM q WHERE place <= 100""",
    "render_selection": """WITH i AS (SELECT CASE l_partkey % 4 WHEN 0 THEN 'unchecked' WHEN 1 THEN 'rendered' WHEN 2 THEN 'pdf_error' ELSE 'no_pdf' END AS render_status FROM lineitem
            WHERE l_partkey % 9 <> 0 AND l_suppkey % 2 = 0 AND l_partkey % 5 <> 0)
        SELECT render_status, FALSE AS redo, count(*) AS n FROM i WHERE render_status IN ('unchecked', 'pdf_error') GROUP BY 1 UNION ALL SELECT render_status, TRUE, count(*) FROM i GROUP BY 1""",
    "verdict_ingest": "SELECT CASE WHEN doc_id % 4 = 0 THEN 'rejected' WHEN doc_id % 6 = 1 THEN 'duplicate' ELSE 'new' END AS outcome, count(*) AS n FROM labels GROUP BY 1",
    "paper_hits": """SELECT user_id, count(*) AS hit_count, count(*) FILTER (event_type = 'purchase') AS relevant_hit_count, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS statuses,
        string_agg(DISTINCT CAST(event_id % 5 AS VARCHAR), '; ' ORDER BY CAST(event_id % 5 AS VARCHAR)) AS terms, string_agg(DISTINCT CAST(event_id % 3 AS VARCHAR), '; ' ORDER BY CAST(event_id % 3 AS VARCHAR)) AS sources,
        's' || coalesce(min(event_id) FILTER (event_type = 'purchase'), min(event_id)) AS representative_snippet, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 'probable_author_ai_use' ELSE 'possible_only' END AS auto_class
        FROM events GROUP BY 1""",
    "reservations": """WITH r AS (SELECT event_type, event_id, value, ((strlen(props) + 100) * 3.75e0 + 1000 * 15e0) / 1e6 AS reserved FROM events)
        SELECT event_type, round(sum(reserved), 6) AS reserved, round(sum(CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 3 <> 0 THEN value / 1e5 ELSE reserved END), 6) AS settled FROM r GROUP BY 1""",
    "newest": "SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS n FROM events",
}
