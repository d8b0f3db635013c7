"""Text operators over documents, pages and benchmark passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import lexicon as L
from ..operators import providers as V
from ..operators import quotes as Q
from ..operators import sessions as S
from ..sources import tables as T
from ..workspace import Workspace, spread
from .common import table

#: A lexicon for the driver's texts: term, tier, pattern that all regular-expression engines read alike.
TERMS = [
    ("license", "llm", r"[Ll]icensed"),
    ("license", "llm", r"[Ll]icense,"),
    ("mail", "generic", r"[a-z0-9.]+@[a-z0-9.]+"),
    ("insult", "llm", r"idiot|moron|pathetic|worthless"),
    ("number", "ml", r"[0-9][0-9][0-9]+"),
]
_VALUES = ", ".join(f"('{t}', '{tier}', '{p}')" for t, tier, p in TERMS)
RULES = [("negation", r"[Nn]ot |[Nn]o "), ("licence", r"[Ll]icense"), ("contact", r"@"), ("digits", r"[0-9]")]

# Offsets come from the pieces between matches, as the lengths of all pieces and matches before.
_HITS_SQL = f"""WITH t(term, tier, p) AS (VALUES {_VALUES}),
x AS (SELECT doc_id, text, term, tier, p, regexp_extract_all(text, p) AS ms, regexp_split_to_array(text, p) AS ps FROM documents, t WHERE regexp_matches(text, p)),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM x),
hits AS (SELECT doc_id, text, term, tier, CAST(list_sum(list_transform(ps[1:CAST(i AS BIGINT)], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:CAST(i - 1 AS BIGINT)], lambda s: length(s))), 0) AS BIGINT) AS "offset", ms[CAST(i AS BIGINT)] AS matched FROM i)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, term, tier, offset, matched: all patterns in one pass over the texts."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").where(F.col("text").rlike("|".join(p for _, _, p in TERMS)))

    def of_term(term: str, tier: str, pattern: str) -> Column:
        hit = lambda h: F.struct(F.lit(term).alias("term"), F.lit(tier).alias("tier"), h["offset"].cast("long").alias("offset"), h["matched"].alias("matched"))
        return F.transform(X.match_positions(F.col("text"), pattern), hit)

    found = F.flatten(F.array(*[of_term(*t) for t in TERMS]))
    return docs.select("doc_id", "text", F.inline(found))


def hit_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).drop("text")


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and documents by term."""
    return _hits(spark, sf_dir).groupBy("term", "tier").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("documents"))


def flagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flagged(_hits(spark, sf_dir).withColumn("rule_class", F.lit("plain")), "doc_id")


def hit_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of hits at most 600 characters apart, with their terms."""
    chained = S.gap_sessions(_hits(spark, sf_dir), ["doc_id"], "offset", S.MERGE_GAP, "term")
    told = chained.groupBy("doc_id", "session").agg(F.sort_array(F.collect_set("term")).alias("ts"), F.count(F.lit(1)).alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))
    return told.select("doc_id", F.array_join("ts", ",").alias("terms"), "n", "first_offset", "last_offset")


def merged_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of hits as snippets: terms, ids in order, and the longest context as a hash."""
    k = F.create_map(*[x for i, t in enumerate(dict.fromkeys(t for t, _, _ in TERMS)) for x in (F.lit(t), F.lit(i))])
    hits = _hits(spark, sf_dir).groupBy("doc_id", "text", "term", "offset").agg(F.count(F.lit(1)).alias("_n"))
    hits = hits.withColumns({"id": F.col("offset") * 10 + F.element_at(k, F.col("term")), "context": X.window(F.col("text"), F.col("offset").cast("int"), X.METADATA_RADIUS)})
    told = S.merge_snippets(hits, ["doc_id"])
    return told.select("doc_id", F.array_join("terms", ",").alias("terms"), F.array_join("hit_ids", ",").alias("hit_ids"), F.sha2("context", 256).alias("context_sha256"), "first_offset", "last_offset")


def list_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a Markdown list, made from documents, by the bucket in which they fall."""
    number, padded = F.floor(F.col("doc_id") / 12), lambda c, n: F.lpad(c.cast("string"), n, "0")
    # Ids have five digits a month, so documents go on into later years: 120 million of them have an id of their own.
    own = F.concat(padded((F.floor(number / 100_000) + 24) % 100, 2), padded(F.col("doc_id") % 12 + 1, 2), F.lit("."), padded(number % 100_000, 5))
    own = F.when(F.col("doc_id") >= 120_000_000, F.raise_error(F.lit("no ids for over 120 million documents")).cast("string")).otherwise(own)
    docs = table(spark, sf_dir, "documents").select("doc_id", own.alias("arxiv_id"))
    url = F.when(F.col("doc_id") % 7 == 0, "http://example.org/x").otherwise(F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id")))
    entries = T.parse_list(docs.select(F.concat(F.lit("| **[Title]("), url, F.lit(")** | NT, CO |")).alias("value")))
    papers = docs.where("doc_id % 5 <> 0").select("arxiv_id", F.when(F.col("doc_id") % 3 == 0, "cs.AI").otherwise("math.NT").alias("primary_category"))
    told = T.list_buckets(entries, papers, docs.where("doc_id % 2 = 0"), [f"{y:02}{m:02}" for y in range(100) for m in range(1, 7)])
    return told.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def hit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text around each hit, as a hash and a length."""
    around = X.window(F.col("text"), F.col("offset").cast("int"), X.METADATA_RADIUS)
    return _hits(spark, sf_dir).select("doc_id", "term", "offset", F.sha2(around, 256).alias("context_sha256"), F.length(around).cast("long").alias("chars"))


def rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by the first rule that their surroundings meet."""
    around = X.window(F.col("text"), F.col("offset").cast("int"), L.CLASS_RADIUS)
    return _hits(spark, sf_dir).select("term", X.first_class(around, RULES, "plain").alias("rule_class")).groupBy("term", "rule_class").agg(F.count(F.lit(1)).alias("n"))


#: Sentences that lexicon_scan sets before the texts, and the hits in them: term, tier, offset, matched, rule class.
PLANTED = [
    ("", []),
    ("We thank ChatGPT for help with editing.", [("ChatGPT", "llm", 9, "ChatGPT", "ack_usage")]),
    ("No AI was used; we did not use ChatGPT.", [("AI-bare", "generic", 3, "AI", "negation_context"), ("ChatGPT", "llm", 31, "ChatGPT", "negation_context")]),
    ("Université Claude Bernard Lyon", [("Claude", "llm", 11, "Claude", "known_fp")]),
    ("verified in Lean by computation", [("Lean", "prover", 12, "Lean", "usage_context")]),
    ("GPT-4o wrote this", [("GPT", "llm", 0, "GPT-4o", "plain")]),
    ("AI Usage: Claude Code", [("AI-bare", "generic", 0, "AI", "disclosure_genre"), ("AI-compound", "generic", 0, "AI Usage", "disclosure_genre"), ("Claude", "llm", 10, "Claude Code", "disclosure_genre")]),
    ("large language models and mathlib", [("large language model", "llm", 0, "large language models", "usage_context"), ("mathlib", "prover", 26, "mathlib", "usage_context")]),
    ("a lean argument of the bard", []),
]


def lexicon_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the full lexicon in documents, lower-cased, after a sentence of known hits; dots keep the windows of hits apart from the text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", tasks=8)
    first = F.element_at(F.array(*[F.lit(x) for x, _ in PLANTED]), (F.pmod("doc_id", F.lit(len(PLANTED))) + 1).cast("int"))
    text = F.concat(first, F.repeat(F.lit(" ."), 400), F.lit(" "), F.lower(F.coalesce("text", F.lit(""))))
    return L.scan(docs.select("doc_id", text.alias("text")), ["doc_id"]).drop("context")


def source_and_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the full lexicon in two metadata fields, and documents without any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    told = L.scan_metadata(docs, "doc_id", ["lang", "source"])
    return told.groupBy(F.col("term").isNotNull().alias("hit")).agg(F.count_distinct("doc_id").alias("documents"))


def metadata_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the full lexicon in a comment that each language's documents have, and in their source."""
    said = F.create_map(*[F.lit(x) for pair in COMMENTS.items() for x in pair])
    docs = table(spark, sf_dir, "documents").select("doc_id", F.try_element_at(said, F.col("lang")).alias("comments"), "source")
    told = L.scan_metadata(docs, "doc_id", ["comments", "source"])
    return told.select("doc_id", "kind", "term", F.col("offset").cast("long").alias("offset"), "matched", "rule_class")


#: Comments by language: a disclosure, a name that is none, a prover, and nothing.
COMMENTS = {"en": "Declaration: we used GPT-4o to edit", "fr": "Université Claude Bernard, 12 pages", "de": "checked in Lean 4"}


def stripped_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dressed as source: halves of their texts in comments, behind switches, in links and after the end go, the rest stays."""
    text = F.regexp_replace("text", r"[%~\\{}]", " ")
    left, right = F.left(text, F.lit(200)), F.substring(text, 201, F.lit(1_000_000_000))
    whole = F.concat(left, F.lit("\\begin{comment}"), right, F.lit("\\end{comment}|\\iffalse "), right, F.lit("\\fi|\\href{http://x.org/a%20b}{"), right, F.lit("} 5\\% kept % gone \n|\\'{e}~\\begin{comment}"), left, F.lit("\\end{comment}"), left, F.lit("\\end{document}"), right)
    c = X.plain_accents(X.strip_comments(whole))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("chars"), F.sha2(c, 256).alias("sha256"))


def anchored_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of hits that begin within 3,000 characters of the block's first."""
    return S.anchored_blocks(_hits(spark, sf_dir), ["doc_id"], "offset")


def highlight_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions of hits that touch within 40 characters."""
    rows = _hits(spark, sf_dir).select("doc_id", F.col("offset").alias("lo"), (F.col("offset") + F.length("matched") + 40).alias("hi"))
    return S.interval_union(rows, ["doc_id"], "lo", "hi")


def provider_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the first rule that their host meets."""
    rules = [("blog", r"//blog\."), ("mobile", r"//m\."), ("com", r"\.com/"), ("net", r"\.net/")]
    return table(spark, sf_dir, "pages").select(V.ordered_rules(F.col("url"), "spam", rules, V.UNCLEAR).alias("provider")).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def tool_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers of part names that stand for tools, and whether these are agentic."""
    names = table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in ("ChatGPT 4", "Claude Code", "Gemini Pro", "Lean 4", "Copilot", "Kimi", "my own model", "o3 mini")]), (F.col("p_partkey") % 8 + 1).cast("int")).alias("tool"))
    return names.groupBy("tool", V.provider_of(F.col("tool")).alias("provider"), V.is_agentic(F.col("tool")).alias("agentic")).agg(F.count(F.lit(1)).alias("n"))


def quote_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, document) pairs in which the passage stands word for word.

    Passages meet documents by the rarest of their words, and only (document,
    word) rows take part in that join; candidates then meet their texts.
    """
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    work, words = Workspace(spark, "containment"), F.split(F.col("text"), r"\s+")
    # The words at a passage's ends may go on in the document; those between cannot.
    inner = F.array_distinct(F.filter(F.slice(words, 2, F.greatest(F.lit(0), F.size(words) - 2)), lambda w: w != ""))
    asked = items.select("item_id", F.explode(inner).alias("word"))
    # Of the documents' words only those of passages are counted and kept, once; the list is as long as the passages' vocabulary.
    spread_docs = spread(docs.select("doc_id", "text"), "doc_id")
    held = work.save(spread_docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(asked.select("word").distinct(), "word", "left_semi"), "held")
    counted = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(counted, "word", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("w")).select("item_id", "w.word")
    met = held.join(rarest, "word").select("item_id", "doc_id")
    passages = items.select("item_id", F.col("text").alias("passage"))
    texts = met.join(docs.select("doc_id", "text"), "doc_id").join(passages, "item_id")
    found = texts.where(F.contains("text", "passage")).select("item_id", "doc_id")
    # Passages of fewer than three words have no such word. They meet the documents by their pieces: parted at white space,
    # a passage stands in a text only if its pieces stand in words of the text that follow each other; the longest piece is enough to ask for.
    short = passages.where((F.size(F.split("passage", r"\s+")) < 3) & (F.length("passage") > 0))
    if short.limit(1).count():
        longest = F.array_max(F.transform(F.split("passage", r"\s+"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
        pieces = work.save(short.select(longest.alias("piece")).distinct(), "pieces")
        vocabulary = spread_docs.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
        # Words that hold a piece, by the strings inside them of the lengths that pieces have.
        sizes = [r[0] for r in pieces.select(F.length("piece").alias("n")).distinct().collect() if r[0]]  # as many as there are lengths of words
        grams = lambda n: F.transform(F.when(F.length("word") >= n, F.sequence(F.lit(1), F.length("word") - n + 1)), lambda i: F.substring(F.col("word"), i, F.lit(n)))
        inside = vocabulary.select("word", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*[grams(n) for n in sizes]))))).alias("piece")).join(pieces, "piece") if sizes else None
        asked_short = short.withColumn("piece", longest)
        if inside is not None:
            near = spread_docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(inside, "word").join(asked_short, "piece").select("doc_id", "item_id", "passage").distinct()
            found = found.unionByName(near.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id"))
        # Passages of nothing but white space stand where the same white space does.
        blank = short.where(F.trim(F.regexp_replace("passage", r"\s+", "")) == "")
        if blank.limit(1).count():
            found = found.unionByName(docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\s+"), F.lit(0)))).alias("run")).distinct().join(blank, F.contains("run", "passage")).select("item_id", "doc_id"))
    return found.distinct()


def quote_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in which each whole passage stands: exactly, without hyphens, or nearly."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return Q.quotes_in(items, table(spark, sf_dir, "documents").select("doc_id", "text"))


def stripped_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source: percent comments go, then accents."""
    c = X.plain_accents(X.strip_comments(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("chars"), F.sha2(c, 256).alias("sha256"))


def middle_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.middle_cut(F.col("text"), 3000)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("chars"), F.sha2(c, 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (hit_offsets, term_hits, flagged_documents, hit_snippets, merged_snippets, list_reconciliation, hit_contexts, rule_class, lexicon_scan, source_and_language, metadata_hits, stripped_environments, anchored_excerpts, highlight_spans, provider_buckets, tool_providers, quote_containment, quote_matches, stripped_sources, middle_cut)}
_WINDOW = lambda r: f'substr(text, CAST(greatest(0, "offset" - {r}) + 1 AS BIGINT), CAST("offset" + {r} - greatest(0, "offset" - {r}) AS BIGINT))'
ORACLE_SQL = {
    "hit_offsets": _HITS_SQL + 'SELECT doc_id, term, tier, "offset", matched FROM hits',
    "term_hits": _HITS_SQL + "SELECT term, tier, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM hits GROUP BY 1, 2",
    "flagged_documents": "SELECT doc_id FROM documents WHERE regexp_matches(text, '[Ll]icensed|[Ll]icense,|[a-z0-9.]+@[a-z0-9.]+|idiot|moron|pathetic|worthless')",
    "hit_snippets": _HITS_SQL + """, o AS (SELECT *, CASE WHEN "offset" - lag("offset") OVER w <= 600 THEN 0 ELSE 1 END AS opens FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY "offset", term)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY "offset", term) AS session FROM o)
        SELECT doc_id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, count(*) AS n, min("offset") AS first_offset, max("offset") AS last_offset FROM s GROUP BY doc_id, session""",
    "merged_snippets": _HITS_SQL + f""", d AS (SELECT DISTINCT doc_id, text, term, "offset" FROM hits),
        k AS (SELECT *, "offset" * 10 + CASE term WHEN 'license' THEN 0 WHEN 'mail' THEN 1 WHEN 'insult' THEN 2 ELSE 3 END AS id, {_WINDOW(400)} AS ctx FROM d),
        o AS (SELECT *, CASE WHEN "offset" - lag("offset") OVER w <= 600 THEN 0 ELSE 1 END AS opens FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY "offset", id)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY "offset", id) AS session FROM o)
        SELECT doc_id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms, string_agg(CAST(id AS VARCHAR), ',' ORDER BY "offset", id) AS hit_ids,
            sha256((list(ctx ORDER BY length(ctx) DESC, "offset", id))[1]) AS context_sha256, min("offset") AS first_offset, max("offset") AS last_offset FROM s GROUP BY doc_id, session""",
    "list_reconciliation": """SELECT CASE WHEN doc_id % 7 = 0 THEN 'no_arxiv_id' WHEN doc_id % 12 >= 6 THEN 'out_of_frame_window' WHEN doc_id % 5 = 0 THEN 'not_in_db' WHEN doc_id % 3 = 0 THEN 'out_of_frame_category'
        WHEN doc_id % 2 = 1 THEN 'in_frame_not_flagged' ELSE 'in_frame_flagged' END AS bucket, count(*) AS n FROM documents GROUP BY 1""",
    "stripped_sources": """WITH c AS (SELECT doc_id, replace(regexp_replace(text, '(^|[^\\\\])%[^\\n]*', '\\1', 'g'), '~', ' ') AS c FROM documents)
        SELECT doc_id, length(c) AS chars, sha256(c) AS sha256 FROM c""",
    "hit_contexts": _HITS_SQL + f'SELECT doc_id, term, "offset", sha256({_WINDOW(400)}) AS context_sha256, length({_WINDOW(400)}) AS chars FROM hits',
    "rule_class": _HITS_SQL + f""", c AS (SELECT term, {_WINDOW(300)} AS around FROM hits)
        SELECT term, CASE WHEN regexp_matches(around, '[Nn]ot |[Nn]o ') THEN 'negation' WHEN regexp_matches(around, '[Ll]icense') THEN 'licence'
            WHEN regexp_matches(around, '@') THEN 'contact' WHEN regexp_matches(around, '[0-9]') THEN 'digits' ELSE 'plain' END AS rule_class, count(*) AS n FROM c GROUP BY 1, 2""",
    "highlight_spans": _HITS_SQL + """, r AS (SELECT doc_id, "offset" AS lo, "offset" + length(matched) + 40 AS hi FROM hits),
        m AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
        b AS (SELECT *, sum(CASE WHEN lo <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS block FROM m)
        SELECT doc_id, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM b GROUP BY doc_id, block""",
    "anchored_excerpts": "WITH RECURSIVE " + _HITS_SQL.removeprefix("WITH ") + """, o AS (SELECT doc_id, "offset" AS pos, row_number() OVER (PARTITION BY doc_id ORDER BY "offset") AS k FROM hits),
        f AS (SELECT doc_id, k, pos, pos AS start FROM o WHERE k = 1
              UNION ALL SELECT o.doc_id, o.k, o.pos, CASE WHEN o.pos - f.start < 3000 THEN f.start ELSE o.pos END FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
        SELECT doc_id, start AS block_low, max(pos) AS block_high, count(*) AS n FROM f GROUP BY doc_id, start""",
    "provider_buckets": """SELECT CASE WHEN regexp_matches(url, '(?i)spam') THEN NULL WHEN regexp_matches(url, '(?i)//blog\\.') THEN 'blog' WHEN regexp_matches(url, '(?i)//m\\.') THEN 'mobile'
        WHEN regexp_matches(url, '(?i)\\.com/') THEN 'com' WHEN regexp_matches(url, '(?i)\\.net/') THEN 'net' ELSE 'Other/unclear' END AS provider, count(*) AS n FROM pages GROUP BY 1""",
    "tool_providers": """WITH v(i, tool, provider, agentic) AS (VALUES (0, 'ChatGPT 4', 'OpenAI', FALSE), (1, 'Claude Code', 'Anthropic', TRUE), (2, 'Gemini Pro', 'Google', FALSE), (3, 'Lean 4', NULL, FALSE),
        (4, 'Copilot', 'Microsoft', TRUE), (5, 'Kimi', 'Moonshot', FALSE), (6, 'my own model', 'Other/unclear', FALSE), (7, 'o3 mini', 'OpenAI', FALSE))
        SELECT tool, provider, agentic, count(*) AS n FROM part JOIN v ON i = p_partkey % 8 GROUP BY ALL""",
    "quote_containment": "SELECT DISTINCT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)",
    "middle_cut": """WITH c AS (SELECT doc_id, CASE WHEN length(text) > 3000 THEN left(text, 2000) || chr(10) || '[...]' || chr(10) || right(text, 1000) ELSE text END AS c FROM documents)
        SELECT doc_id, length(c) AS chars, sha256(c) AS sha256 FROM c""",
    "lexicon_scan": f"""WITH p(k, term, tier, "offset", matched, rule_class) AS (VALUES {", ".join(f"({k}, '{t}', '{tier}', {at}, '{m}', '{c}')" for k, (_, hits) in enumerate(PLANTED) for t, tier, at, m, c in hits)})
        SELECT doc_id, term, tier, "offset", matched, rule_class FROM documents JOIN p ON k = doc_id % {len(PLANTED)}""",
    "metadata_hits": """WITH p(lang, term, "offset", matched, rule_class) AS (VALUES ('en', 'GPT', 21, 'GPT-4o', 'disclosure_genre'), ('fr', 'Claude', 11, 'Claude', 'known_fp'), ('de', 'Lean', 11, 'Lean 4', 'usage_context'))
        SELECT doc_id, CASE WHEN term IS NOT NULL THEN 'meta:comments' END AS kind, term, "offset"::BIGINT AS "offset", matched, rule_class FROM documents LEFT JOIN p USING (lang)""",
    "stripped_environments": """WITH t AS (SELECT doc_id, regexp_replace(text, '[%~\\\\{}]', ' ', 'g') AS t FROM documents),
        c AS (SELECT doc_id, left(t, 200) || '||\\href{http://x.org/a%20b}{' || substr(t, 201) || '} 5\\% kept ' || chr(10) || '|e ' || left(t, 200) || '\\end{document}' AS c FROM t)
        SELECT doc_id, length(c) AS chars, sha256(c) AS sha256 FROM c""",
    "source_and_language": "SELECT FALSE AS hit, count(*) AS documents FROM documents",
}
