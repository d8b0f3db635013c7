"""Audit of how far the sources of a language diverge in the terms they use.

Plain relational: terms are regular-expression matches, exploded and counted by
group of language and source. Each language keeps the terms of at least
``LEAST_DOCS`` of its documents. Groups are crossed with the kept terms of their
language, so that a term without occurrences counts as zero; from smoothed
shares in billionths follow, by a self-join on language and term, the distance
of every two sources, and by comparison with the whole language the terms that
a source overuses.

A document sends each of its terms, and each distinct one again, into one
aggregation, which combines before the shuffle: no document is shuffled. The
cross of groups and terms is an equi-join on language and a deal of at most
about ``DEAL`` terms, so a language of most rows spreads over tasks; groups are
copied once for each deal, a ``DEAL``-th of what the cross gives. Self-joined
keys hold one row for each source of a language.

Defined results: null text, language or source counts as ''; an empty text, or
one without terms, still makes its group occur; repeated rows count each; very
long texts count in full; ties of values go by the item's UTF-8 bytes; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, join_groups, read

#: Letters A-Z, a-z and everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that a kept term has, and how many terms of a group are told.
LEAST_DOCS, MOST_TERMS = 30, 50
#: Added to each count; shares are in such parts.
PRIOR, PARTS = 5, 1_000_000_000
#: Terms of a language that one key of the cross holds, about.
DEAL = 64


def _named(docs: DataFrame, lang_col: str, source_col: str) -> list:
    return [F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Only A-Z are lower-cased; where there is nothing but ASCII the two agree, and lower() is faster.
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))
    # A generator of one row keeps the pattern from being matched again for each use of its result.
    found = docs.select(*_named(docs, lang_col, source_col), F.explode(F.array(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))).alias("terms"))
    twice = found.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("once", "terms"))
    each = twice.select("lang", "source", "once", F.explode("terms").alias("term"))
    return each.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def _share(n: str, total: str) -> str:
    """The smoothed share in billionths, exactly; 0 where no term is kept."""
    return f"CASE WHEN v > 0 THEN 1 + CAST({PARTS} AS DECIMAL(10, 0)) * CAST({n} + {PRIOR} AS DECIMAL(19, 0)) DIV CAST({total} + {PRIOR} * v AS DECIMAL(20, 0)) ELSE 0 END"


def kept_terms(groups: DataFrame, counts: DataFrame, work: Workspace, least_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, n of each kept term; lang, v, lang_total of every language); a language without kept terms has the term '', which no text has."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs)
    kept = work.save(kept.select("lang", "term", "lang_n"), "kept")
    sums = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = work.save(groups.select("lang").distinct().join(sums, "lang", "left").na.fill(0, ["v", "lang_total"]), "langs")
    return kept.unionByName(langs.where("v = 0").select("lang", F.lit("").alias("term"), F.lit(0).cast("long").alias("lang_n"))), langs


def shares(groups: DataFrame, counts: DataFrame, work: Workspace, least_docs: int) -> DataFrame:
    """lang, source, term, n, p, q for each group and each kept term of its language, occurring there or not."""
    kept, langs = kept_terms(groups, counts, work, least_docs)
    deals = langs.withColumn("deals", F.ceil(F.greatest("v", F.lit(1)) / DEAL).cast("int"))
    met = join_groups(kept, deals.withColumn("size", F.greatest("v", F.lit(1))), "lang", "size", ["v", "lang_total", "deals"], F.col("term"))
    met = met.withColumn("deal", F.pmod(F.xxhash64("term"), F.col("deals")).cast("int")).drop("deals")
    inside = work.save(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term"), ["lang", "term"]), "inside")
    sized = groups.join(inside.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").na.fill(0, ["total"])
    copies = sized.join(deals.select("lang", "deals"), "lang").select("lang", "source", "total", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    dense = copies.join(met, ["lang", "deal"]).join(inside, ["lang", "source", "term"], "left").na.fill(0, ["n"])
    return work.save(dense.select("lang", "source", "term", "n", F.expr(_share("n", "total")).alias("p"), F.expr(_share("lang_n", "lang_total")).alias("q")), "shares")


def divergence_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: of each group, all other sources of its language by distance, and the terms it overuses most."""
    work = Workspace(docs.sparkSession, "divergence")
    groups = work.save(docs.select(*_named(docs, lang_col, source_col)).distinct(), "groups")
    counts = work.save(term_counts(docs, text_col, lang_col, source_col), "counts")
    told = shares(groups, counts, work, least_docs)

    one, other = told.select("lang", "term", "source", "p"), told.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p_item"))
    apart = one.join(other, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("p_item"))).alias("value"))
    apart = work.save(apart, "apart")
    pairs = apart.unionByName(apart.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    over = told.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    # Tasks drop what is beyond the limit before the shuffle.
    return ranked(pairs, "pair").unionByName(ranked(over, "term").where(F.col("rank") <= most_terms))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT k, lang, source, unnest(ts) AS term FROM d),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
s AS (SELECT g.lang, g.source, kept.term, coalesce(c.c, 0) AS c,
        1 + (1000000000 * (coalesce(c.c, 0) + 5)::HUGEINT) // (coalesce(n.n, 0) + 5 * v.v)::HUGEINT AS p,
        1 + (1000000000 * (kept.c + 5)::HUGEINT) // (v.n + 5 * v.v)::HUGEINT AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.f, 0) AS f
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY f DESC, item) AS k FROM u)
SELECT lang, source, part, item, f::BIGINT AS value, k::INTEGER AS rank FROM r WHERE part = 'pair' OR k <= 50
"""
