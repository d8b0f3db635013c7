"""Runs compared, harvested, merged and labelled: queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agreement as A
from ..operators import comparison as C
from ..operators import context as X
from ..operators import labelling as B
from ..operators import providers as V
from ..operators import selection as S
from ..sources import pages as G
from ..sources.tables import papers_of, record_struct
from ..streaming import campaigns as L
from ..streaming import upserts as U
from ..streaming.weekly import event_stream
from ..workspace import Workspace
from .common import rounded, table
from .corpus import _HITS_SQL, hit_offsets


def run_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed or pending orders against shipped items, month by month and by priority: urgent ones in one run, returned ones in the other."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", "o_orderstatus")
    one = orders.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("paper"), "month", F.col("o_orderpriority").alias("stratum"), (F.col("o_orderpriority") == "1-URGENT").alias("use"))
    items = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").select(F.col("l_orderkey").alias("paper"), F.lit(None).cast("string").alias("month"), F.lit(None).cast("string").alias("stratum"), (F.col("l_returnflag") == "R").alias("use"))
    return rounded(C.compare_cube(one, items, "paper", "use", ["month", "stratum"]))


def run_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that two sets of labels judge differently, or that only one judges."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    one = labels.select("doc_id", (F.col("toxic") == 1).alias("use"))
    two = docs.where("n_chars > 500").select("doc_id", (F.col("text").rlike("idiot|moron|pathetic|worthless")).alias("use"))
    return C.disagreements(one, two, "doc_id", "use")


def harvested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of records, archived and then read as a stream; toxic ones are deleted records."""
    work, each = Workspace(spark, "harvest"), 100
    title = F.trim(F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(300)), "[^A-Za-z0-9<>&;.]+", " "))
    escaped = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id", F.lit(' status="deleted"').alias("gone"))
    docs = table(spark, sf_dir, "documents").join(gone, "doc_id", "left").withColumn("page", F.floor(F.col("doc_id") / each).cast("int"))
    raw = F.concat(F.lit("<metadata><arXivRaw><id>"), F.col("doc_id").cast("string"), F.lit("</id><title>"), escaped, F.lit("</title><categories>"), F.col("lang"), F.lit(" "), F.col("source"), F.lit("</categories></arXivRaw></metadata>"))
    record = F.concat(F.lit("<record><header"), F.coalesce("gone", F.lit("")), F.lit("><datestamp>2024-01-01</datestamp></header>"), F.when(F.col("gone").isNull(), raw).otherwise(""), F.lit("</record>"))
    last = docs.agg(F.max("page")).first()[0]
    told = docs.select("page", record.alias("record")).groupBy("page").agg(F.concat_ws("", F.collect_list("record")).alias("records"))  # a page has so many at most
    token = F.when(F.col("page") < F.lit(last), F.concat(F.lit("next-"), F.col("page").cast("string"))).otherwise("")
    page = F.concat(F.lit("<OAI-PMH><ListRecords>"), "records", F.lit("<resumptionToken>"), token, F.lit("</resumptionToken></ListRecords></OAI-PMH>"))
    told.select(F.lpad(F.col("page").cast("string"), 9, "0").alias("page"), page.alias("xml")).write.partitionBy("page").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(f"{work.path}/archive")  # a folder a page: each task puts its own in place
    records = U.stream_to_files(G.page_stream(spark, f"{work.path}/archive"), work, "records")
    papers = papers_of(records.select("page", record_struct(F.col("record")).alias("r")).select("page", "r.*"), "page")
    return papers.select(F.col("arxiv_id").cast("long").alias("doc_id"), (F.col("page") - 1).cast("long").alias("page"), "title", "primary_category")


def stream_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and type, merged batch by batch from a stream that tells every event twice."""
    work = Workspace(spark, "upserts")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    work.save(events.unionByName(events), "events")
    held = U.UpsertTable(spark, f"{work.path}/held", ["user_id", "event_type"], "event_id", merges=2)
    stream = event_stream(spark, f"{work.path}/events", files=4)
    U.upsert_stream(stream, held, f"{work.path}/checkpoint", at="ts", ids=["event_id"], late="3650 days").awaitTermination()
    return held.read().select("user_id", "event_type", "event_id", "value")


#: Rules of the stand-in labeller, and the longest prompt that it answers.
RULES, MOST_CHARS = [("unclear", "idiot|moron|pathetic|worthless"), ("non_use_statement", "[Ll]icensed|[Ll]icense,")], 20_000


def labelled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in batches of 30 of a language, put to a labeller that refuses long prompts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    told, _ = B.label_batches(docs, B.RuleLabeller(RULES, MOST_CHARS), Workspace(spark, "labelled"), "doc_id", "text", "lang")
    return told.select(F.col("group").alias("lang"), "batch", F.col("key").cast("long").alias("doc_id"), "split_path", F.col("label.polarity").alias("polarity"), F.substring_index("reason", ":", 2).alias("reason"))


def label_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the requests behind ``labelled_batches``: how many snippets, and whether they were answered."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    _, records = B.label_batches(docs, B.RuleLabeller(RULES, MOST_CHARS), Workspace(spark, "labelled"), "doc_id", "text", "lang")
    return records.select(F.col("group").alias("lang"), "batch", "split_path", F.size("keys").cast("long").alias("n"), F.element_at("keys", 1).cast("long").alias("first_doc"), F.col("response_sha256").isNotNull().alias("answered"))


#: Events in a file of the stream, about.
EVENTS_A_FILE = 1_000_000


def campaign_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as those of their users' campaigns, from a stream in three parts: signups create, purchases reserve, clicks settle, errors close."""
    work, events = Workspace(spark, "campaigns"), table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "created", "purchase", "reserved", "click", "settled", "view", "amended", "error", "closed")]), F.col("event_type"))
    usd = F.when(kind == "created", F.col("value") * 5).otherwise(F.col("value"))
    told = events.select(F.col("user_id").cast("string").alias("campaign"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("r"), (F.floor("value") % 4).cast("string")).alias("request"), usd.alias("usd"))
    third = F.floor(F.col("seq") * 3 / F.lit((told.agg(F.max("seq")).first()[0] or 0) + 1))
    files = 1 + told.groupBy(third.alias("part")).count().agg(F.min("count")).first()[0] // EVENTS_A_FILE if told.limit(1).count() else 1
    for part in range(3):  # files in the order of events, as many for each part
        told.where(third == part).repartition(files).write.mode("append").parquet(f"{work.path}/events")
    stream = event_stream(spark, f"{work.path}/events", files=files)
    return rounded(U.stream_to_files(L.campaign_ledger(stream), work, "outcomes"))


def hit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with the last line that begins with a capital at or before them, at most 2,500 characters away."""
    hits, docs = hit_offsets(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    told = X.with_sections(hits, docs, Workspace(spark, "sections"), "doc_id", pattern=LINE)
    return told.select("doc_id", "term", "tier", "offset", "section", "section_distance")


def hit_context_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by the older class of their context; headings are lines of a few capitals' words."""
    hits, docs = hit_offsets(spark, sf_dir), table(spark, sf_dir, "documents").select("doc_id", "text")
    told = X.classified(hits, docs, Workspace(spark, "contexts"), "doc_id", pattern=LINE)
    return told.groupBy("term", "context_class").agg(F.count(F.lit(1)).alias("n"), F.count("section").alias("with_section"))


def reviewer_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of 25 labelled documents for each of three reviewers: twenty planted ones are shown without excerpts, none of them among a reviewer's first forty."""
    labels, work = table(spark, sf_dir, "labels"), Workspace(spark, "packets")
    frame = labels.select(F.col("doc_id").alias("arxiv_id"), F.when(F.col("toxic") == 1, "POS").when(F.col("quality") == 0, "FLAG").otherwise("NEG").alias("stratum"))
    orders = work.save(A.reviewer_orders(frame, ["ada", "ben", "cyd"], 7, work), "all-orders")
    plants = A.plant(frame, orders, 20, 40, 7)
    excerpts = hit_offsets(spark, sf_dir).groupBy(F.col("doc_id").alias("arxiv_id")).agg(F.count(F.lit(1)).alias("excerpts"))
    return A.packets(orders, plants, excerpts, 7, 25).withColumnRenamed("arxiv_id", "doc_id")


#: Tools that labels may name.
TOOLS = ("ChatGPT", "GPT-4o", "Claude Code", "Gemini", "Lean", "Copilot", "Sage", "own model", "")


def providers_by_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers: a tool for each part that they order, grounded where an item's comment (its mode, date and quantity) or the part's name bears it out."""
    tool = F.element_at(F.array(*[F.lit(x) for x in TOOLS]), (F.col("l_partkey") % len(TOOLS) + 1).cast("int"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("arxiv_id"), tool.alias("tool"), "l_returnflag", "l_linenumber")
    labels = items.groupBy("arxiv_id").agg(F.collect_set("tool").alias("tools"))
    snippets = items.where("l_returnflag <> 'N'").select("arxiv_id", F.concat(F.lit("We asked "), F.upper("tool"), F.lit(" in line "), F.col("l_linenumber").cast("string")).alias("snippet"))
    return V.provider_papers(V.grounded_tools(labels, snippets))


def selection_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as selected artifacts: their hash, those by ship status, and the hash of the orders in scope."""
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("arxiv_id"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("version"), F.col("l_linestatus").alias("basis"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("path"))
    told, scope = S.selection_record(jobs), S.scope_hash(jobs)
    one = told.select("n", F.to_json("basis_counts").alias("basis_counts"), F.col("selection_sha256").alias("sha256"))
    return one.unionByName(scope.withColumn("basis_counts", F.lit(None).cast("string")))


#: What stands for a heading in the driver's texts: the first word of a line, if that begins with a capital.
LINE = r"\n[A-Z][a-z]+"

QUERIES = {f.__name__: f for f in (run_cube, run_disagreements, harvested_pages, stream_upserts, labelled_batches, label_requests, campaign_outcomes, hit_sections, hit_context_classes, reviewer_packets, providers_by_paper, selection_records)}
# A prompt's length: header and end, then of each snippet its mark, number, text and line ends.
_BATCHES_SQL = f"""WITH RECURSIVE d AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k FROM documents),
    p AS (SELECT lang, k // 30 AS batch, k % 30 AS place, doc_id, text, sum(length(coalesce(text, '')) + {len(B.MARK) + 4}) OVER (PARTITION BY lang, k // 30 ORDER BY k) AS upto FROM d),
    s AS (SELECT lang, batch, list_prepend(0, list(upto ORDER BY place)) AS s, count(*) AS n FROM p GROUP BY 1, 2),
    r AS (SELECT lang, batch, 0 AS lo, n::BIGINT AS hi, 'R' AS path, s FROM s
          UNION ALL SELECT lang, batch, CASE WHEN side = 0 THEN lo ELSE lo + (hi - lo) // 2 END, CASE WHEN side = 0 THEN lo + (hi - lo) // 2 ELSE hi END, path || CASE WHEN side = 0 THEN '.L' ELSE '.R' END, s
          FROM r, (VALUES (0), (1)) v(side) WHERE hi - lo > 1 AND {len(B.HEADER) + len(B.END)} + s[hi + 1] - s[lo + 1] + greatest(0, hi - lo - 10) > {MOST_CHARS}),
    e AS (SELECT lang, batch, lo, hi, path, {len(B.HEADER) + len(B.END)} + s[hi + 1] - s[lo + 1] + greatest(0, hi - lo - 10) > {MOST_CHARS} AS failed FROM r)
"""
_SECTIONS_SQL = _HITS_SQL + f""", hx AS (SELECT doc_id, regexp_extract_all(text, '{LINE}') AS ms, regexp_split_to_array(text, '{LINE}') AS ps FROM documents WHERE regexp_matches(text, '{LINE}')),
    hi AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM hx),
    h AS (SELECT doc_id, CAST(list_sum(list_transform(ps[1:CAST(i AS BIGINT)], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:CAST(i - 1 AS BIGINT)], lambda s: length(s))), 0) AS BIGINT) AS place, ms[CAST(i AS BIGINT)] AS section FROM hi),
    m AS (SELECT hits.doc_id, text, term, tier, "offset", section, "offset" - place AS d FROM hits ASOF LEFT JOIN h ON hits.doc_id = h.doc_id AND hits."offset" >= h.place)
"""
ORACLE_SQL = {
    "campaign_outcomes": """WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'reserved' WHEN 'click' THEN 'settled' WHEN 'view' THEN 'amended' ELSE 'closed' END AS kind,
            CAST(floor(value) AS BIGINT) % 4 + 1 AS i, CASE WHEN event_type = 'signup' THEN value * 5 ELSE value END AS usd, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
        s AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::VARCHAR AS reason, NULL::VARCHAR AS status, NULL::DOUBLE AS cap, 0::DOUBLE AS used, [NULL, NULL, NULL, NULL]::DOUBLE[] AS open FROM e
            UNION ALL
            SELECT user_id, k, seq, kind, reason, CASE WHEN reason IS NULL AND kind = 'created' THEN 'open' WHEN reason IS NULL AND kind = 'closed' THEN 'closed' ELSE status END, CASE WHEN reason IS NULL AND kind = 'created' THEN usd ELSE cap END,
                CASE WHEN reason IS NULL AND kind = 'reserved' THEN used + usd WHEN reason IS NULL AND kind = 'settled' THEN used + usd - held WHEN reason IS NULL AND kind = 'created' THEN 0 ELSE used END,
                CASE WHEN reason IS NULL AND kind IN ('reserved', 'settled') THEN list_transform(range(1, 5), lambda j: CASE WHEN j <> i THEN open[j] WHEN kind = 'reserved' THEN usd END) ELSE open END
            FROM (SELECT e.user_id, e.k, e.seq, e.kind, e.i, e.usd, s.status, s.cap, s.used, s.open, s.open[e.i] AS held,
                    CASE WHEN e.kind = 'created' THEN CASE WHEN s.status IS NOT NULL THEN 'exists' END WHEN s.status IS NULL THEN 'unknown campaign' WHEN s.status = 'closed' AND e.kind <> 'amended' THEN 'closed'
                        WHEN e.kind = 'reserved' THEN CASE WHEN s.open[e.i] IS NOT NULL THEN 'repeated request' WHEN s.used + e.usd > s.cap THEN 'over the cap' END
                        WHEN e.kind = 'settled' AND s.open[e.i] IS NULL THEN 'not open' WHEN e.kind = 'closed' AND list_count(s.open) > 0 THEN 'open reservations' END AS reason
                  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1))
        SELECT user_id::VARCHAR AS campaign, seq, kind, reason IS NULL AS taken, reason, status, round(used, 6) AS used, list_count(open)::INTEGER AS open FROM s WHERE k > 0""",
    "providers_by_paper": """WITH t(i, tool, provider, agentic) AS (VALUES (0, 'ChatGPT', 'OpenAI', FALSE), (1, 'GPT-4o', 'OpenAI', FALSE), (2, 'Claude Code', 'Anthropic', TRUE), (3, 'Gemini', 'Google', FALSE), (4, 'Lean', NULL, FALSE), (5, 'Copilot', 'Microsoft', TRUE), (6, 'Sage', NULL, FALSE), (7, 'own model', 'Other/unclear', FALSE)),
        g AS (SELECT DISTINCT l_orderkey AS k, tool, provider, agentic FROM lineitem JOIN t ON i = l_partkey % 9 WHERE l_returnflag <> 'N'),
        p AS (SELECT k, bool_or(provider IS NOT NULL) AS llm, bool_or(agentic) AS agentic FROM g GROUP BY 1),
        c AS (SELECT 'named' AS measure, NULL AS name, count(*) AS papers FROM p UNION ALL SELECT 'llm', NULL, count(*) FILTER (llm) FROM p UNION ALL SELECT 'agentic', NULL, count(*) FILTER (agentic) FROM p UNION ALL SELECT 'other', NULL, count(*) FILTER (NOT llm) FROM p
            UNION ALL SELECT 'provider', provider, count(DISTINCT k) FROM g WHERE provider IS NOT NULL GROUP BY 2 UNION ALL SELECT 'tool', tool, count(DISTINCT k) FROM g GROUP BY 2)
        SELECT * FROM c WHERE papers > 0""",
    "selection_records": """WITH l AS (SELECT l_orderkey || ':' || CASE WHEN l_linenumber = 3 THEN 'None' ELSE l_linenumber::VARCHAR END || ':' || l_linestatus || ':' || l_returnflag || ':' || l_partkey AS line FROM lineitem),
        b AS (SELECT l_linestatus AS b, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1)
        SELECT count(*) AS n, (SELECT '{' || string_agg('"' || b || '":' || n, ',' ORDER BY b) || '}' FROM b) AS basis_counts, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM l
        UNION ALL SELECT count(*), NULL, sha256(string_agg(k, chr(10) ORDER BY k)) FROM (SELECT DISTINCT l_orderkey::VARCHAR AS k FROM lineitem)""",
    "hit_sections": _SECTIONS_SQL + """SELECT doc_id, term, tier, "offset", CASE WHEN d <= 2500 THEN section END AS section, CASE WHEN d <= 2500 THEN d END AS section_distance FROM m""",
    "hit_context_classes": _SECTIONS_SQL + f""", l AS (SELECT term, section, d, substr(text, CAST(greatest(0, "offset" - 700) + 1 AS BIGINT), CAST("offset" + 700 - greatest(0, "offset" - 700) AS BIGINT)) AS t FROM m)
        SELECT term, CASE WHEN regexp_matches(t, '{X.DENIAL}') AND (regexp_matches(t, '{X.USE}') OR regexp_matches(t, '{X.DISCLOSURE}')) THEN 'negative_ai_use_statement'
            WHEN regexp_matches(t, '{X.THANKS}') AND regexp_matches(t, '{X.DISCLOSURE}') THEN 'likely_ai_use_acknowledgement' WHEN regexp_matches(t, '{X.DISCLOSURE}') THEN 'likely_ai_use_statement' ELSE 'possible_ai_term' END AS context_class,
            count(*) AS n, count(*) FILTER (d <= 2500) AS with_section FROM l GROUP BY 1, 2""",
    "reviewer_packets": _HITS_SQL + """, f AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'POS' WHEN quality = 0 THEN 'FLAG' ELSE 'NEG' END AS stratum FROM labels),
        o AS (SELECT reviewer, doc_id, row_number() OVER (PARTITION BY reviewer ORDER BY md5('7-' || reviewer || '|' || doc_id), doc_id) - 1 AS place FROM f, (VALUES ('ada'), ('ben'), ('cyd')) v(reviewer)),
        p AS (SELECT doc_id FROM f WHERE stratum <> 'NEG' AND doc_id NOT IN (SELECT doc_id FROM o WHERE place < 40) ORDER BY md5('7-plants|' || doc_id), doc_id LIMIT 20),
        xs AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY 1)
        SELECT reviewer, place // 25 AS packet, place % 25 + 1 AS item, left(sha256('7|' || reviewer || '|' || doc_id), 16) AS blind_id, doc_id, doc_id IN (SELECT doc_id FROM p) AS plant,
            CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN 0 ELSE coalesce(n, 0) END AS excerpts FROM o LEFT JOIN xs USING (doc_id)""",
    "labelled_batches": _BATCHES_SQL + f"""SELECT p.lang, p.batch, doc_id, path AS split_path, CASE WHEN failed THEN NULL WHEN regexp_matches(coalesce(text, ''), '{RULES[0][1]}') THEN 'unclear' WHEN regexp_matches(coalesce(text, ''), '{RULES[1][1]}') THEN 'non_use_statement' ELSE 'topic_only' END AS polarity,
        CASE WHEN failed THEN 'RuntimeError: truncated' END AS reason FROM p JOIN e ON p.lang = e.lang AND p.batch = e.batch AND place >= lo AND place < hi WHERE NOT failed OR hi - lo = 1""",
    "label_requests": _BATCHES_SQL + """SELECT e.lang, e.batch, path || CASE WHEN failed THEN '!' ELSE '' END AS split_path, hi - lo AS n, doc_id AS first_doc, NOT failed AS answered FROM e JOIN p ON p.lang = e.lang AND p.batch = e.batch AND place = lo""",
    "run_cube": """WITH a AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS stratum, o_orderpriority = '1-URGENT' AS one FROM orders WHERE o_orderstatus <> 'O'),
        b AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS two FROM lineitem WHERE l_linenumber > 1 GROUP BY 1),
        m AS (SELECT coalesce(month, 'unknown') AS month, coalesce(stratum, 'unknown') AS stratum, a.k IS NOT NULL AS x, b.k IS NOT NULL AS y, coalesce(one, FALSE) AS one, coalesce(two, FALSE) AS two FROM a FULL JOIN b ON a.k = b.k),
        c AS (SELECT month, stratum, grouping(month, stratum)::INTEGER AS level, count(*) FILTER (x AND y) AS common, count(*) FILTER (x AND y AND one) AS positive_one, count(*) FILTER (x AND y AND two) AS positive_two,
            count(*) FILTER (x AND y AND one AND two) AS "both", count(*) FILTER (x AND y AND one AND NOT two) AS only_one, count(*) FILTER (x AND y AND two AND NOT one) AS only_two, count(*) FILTER (x AND y AND NOT one AND NOT two) AS neither,
            count(*) FILTER (NOT y) AS missing_in_two, count(*) FILTER (NOT x) AS missing_in_one, count(*) FILTER (NOT y AND one) AS missing_in_two_positive, count(*) FILTER (NOT x AND two) AS missing_in_one_positive
            FROM m GROUP BY GROUPING SETS ((month, stratum), (month), (stratum), ()))
        SELECT *, round(positive_one::DOUBLE / nullif(common, 0), 6) AS rate_one, round(positive_two::DOUBLE / nullif(common, 0), 6) AS rate_two,
            round(positive_one::DOUBLE / nullif(common, 0) - positive_two::DOUBLE / nullif(common, 0), 6) AS difference, round(("both" + neither)::DOUBLE / nullif(common, 0), 6) AS agreement FROM c""",
    "run_disagreements": """WITH m AS (SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.doc_id IS NOT NULL AS x, d.doc_id IS NOT NULL AS y, toxic = 1 AS one, regexp_matches(text, 'idiot|moron|pathetic|worthless') AS two
            FROM labels l FULL JOIN (SELECT * FROM documents WHERE n_chars > 500) d ON d.doc_id = l.doc_id)
        SELECT doc_id, CASE WHEN NOT y THEN 'missing_in_two' WHEN NOT x THEN 'missing_in_one' WHEN one THEN 'only_one' ELSE 'only_two' END AS outcome FROM m WHERE NOT (x AND y) OR one <> two""",
    "harvested_pages": """SELECT doc_id, doc_id // 100 AS page, nullif(trim(regexp_replace(left(text, 300), '[^A-Za-z0-9<>&;.]+', ' ', 'g')), '') AS title, lang AS primary_category
        FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
    "stream_upserts": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
}
