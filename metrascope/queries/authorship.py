"""Concentration of output: a work is an order, its authors are the suppliers of its items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import concentration as C
from ..operators.prevalence import multi_counts
from ..sources.tables import authorship_problem
from .common import rounded, table

LOOKBACK = 2


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per work and author, in the columns of ``rebuild_papers``."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = F.col("o_orderkey")
    works = orders.select(
        key.alias("work_id"), key.cast("string").alias("arxiv_id"), F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month"),
        F.col("o_orderpriority").alias("subfield"), F.when(F.col("o_orderstatus") != "F", F.floor(F.col("o_totalprice") / 10000)).alias("references"),
        (F.col("o_orderstatus") == "P").alias("truncated"), F.when(key % 7 != 0, F.lit(14).cast("long")).alias("total"),
        F.when(key % 3 == 0, F.lit(1).cast("long")).when(key % 7 != 0, F.lit(0).cast("long")).alias("missing"))
    return works.join(items.select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("author_id")), "work_id")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rebuild_papers(authorships(spark, sf_dir))


_BASE = """
WITH r AS (SELECT o_orderkey AS w, l_suppkey AS author, year(o_orderdate) AS year, o_orderpriority AS subfield,
                  CASE WHEN o_orderstatus <> 'F' THEN CAST(floor(o_totalprice / 10000) AS BIGINT) END AS refs, o_orderstatus = 'P' AS trunc,
                  CASE WHEN o_orderkey % 7 <> 0 THEN 14 END AS total,
                  CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 7 <> 0 THEN 0 END AS missing
           FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
p AS (SELECT w, year, subfield, refs, trunc, total, missing, count(*) AS n_rows, count(DISTINCT author) AS size,
             total IS NOT NULL AND coalesce(missing = 0, FALSE) AND NOT trunc AS complete FROM r GROUP BY ALL),
a AS (SELECT DISTINCT w, author FROM r),
fy AS (SELECT author, min(year) AS first_year FROM r GROUP BY author)
"""


def _metrics_sql(scope: str, analysed: str = "TRUE") -> str:
    return f"""{_BASE},
low AS (SELECT min(year) AS y0 FROM p),
s AS (SELECT p.*, {scope} AS scope, {analysed} AS ana FROM p, low WHERE year >= y0 + {LOOKBACK}),
o AS (SELECT year, scope, author, sum(1e0 / size) AS fr, CAST(count(*) AS DOUBLE) AS fu FROM s JOIN a USING (w) WHERE ana GROUP BY ALL),
k AS (SELECT o.*, first_year, y0, count(*) OVER g AS n, row_number() OVER (PARTITION BY year, scope ORDER BY fr) AS i,
             row_number() OVER (PARTITION BY year, scope ORDER BY fr DESC) AS d, row_number() OVER (PARTITION BY year, scope ORDER BY fu) AS fi,
             row_number() OVER (PARTITION BY year, scope ORDER BY fu DESC) AS fd
      FROM o JOIN fy USING (author), low WINDOW g AS (PARTITION BY year, scope)),
b AS (SELECT year, scope, count(*) AS m, avg(CASE WHEN year = first_year THEN 1e0 ELSE 0e0 END) AS fresh, avg(CASE WHEN year - first_year <= 3 THEN 1e0 ELSE 0e0 END) AS early,
             median(year - first_year) AS age, avg(CASE WHEN first_year = y0 THEN 1e0 ELSE 0e0 END) AS censored,
             sum(CASE WHEN d <= greatest(1, ceil(0.01e0 * n)) THEN fr ELSE 0e0 END) / sum(fr) AS t1,
             sum(CASE WHEN d <= greatest(1, ceil(0.05e0 * n)) THEN fr ELSE 0e0 END) / sum(fr) AS t5,
             sum(CASE WHEN d <= greatest(1, ceil(0.1e0 * n)) THEN fr ELSE 0e0 END) / sum(fr) AS t10,
             sum(CASE WHEN fd <= greatest(1, ceil(0.1e0 * n)) THEN fu ELSE 0e0 END) / sum(fu) AS f10,
             sum((2e0 * i - n - 1) * fr) / (max(n) * sum(fr)) AS g, sum((2e0 * fi - n - 1) * fu) / (max(n) * sum(fu)) AS fg
      FROM k GROUP BY ALL),
c AS (SELECT year, scope, count(*) AS frame, count(*) FILTER (ana) AS n, avg(CASE WHEN size = 1 THEN 1e0 ELSE 0e0 END) FILTER (ana) AS solo,
             avg(CASE WHEN size >= 3 THEN 1e0 ELSE 0e0 END) FILTER (ana) AS team3, avg(CAST(size AS DOUBLE)) FILTER (ana) AS mean_size, median(size) FILTER (ana) AS med_size,
             avg(CAST(refs AS DOUBLE)) FILTER (ana) AS mean_refs, median(refs) FILTER (ana) AS med_refs, CAST(count(refs) FILTER (ana) AS DOUBLE) AS n_refs,
             avg(CASE WHEN trunc THEN 1e0 ELSE 0e0 END) FILTER (ana) AS trunc, avg(CASE WHEN total IS NOT NULL AND missing IS NOT NULL THEN 1e0 ELSE 0e0 END) AS known,
             avg(CASE WHEN complete THEN 1e0 ELSE 0e0 END) AS comp, CAST(sum(coalesce(missing, 0)) AS DOUBLE) / nullif(sum(coalesce(total, 0)), 0) AS slots
      FROM s GROUP BY ALL HAVING count(*) FILTER (ana) > 0)
SELECT CAST(year AS BIGINT) AS year, scope, frame AS n_papers_frame, n AS n_papers, m AS n_active_authors, round(CAST(n AS DOUBLE) / m, 6) AS fractional_output_per_author,
       round(fresh, 6) AS new_author_share, round(early, 6) AS early_career_share_0_3, round(CAST(age AS DOUBLE), 6) AS median_observed_math_age, round(censored, 6) AS left_censored_author_share,
       round(solo, 6) AS solo_paper_share, round(team3, 6) AS team_3plus_share, round(mean_size, 6) AS mean_team_size, round(CAST(med_size AS DOUBLE), 6) AS median_team_size,
       round(t1, 6) AS top_1pct_fractional_share, round(t5, 6) AS top_5pct_fractional_share, round(t10, 6) AS top_10pct_fractional_share, round(g, 6) AS gini_fractional_output,
       round(f10, 6) AS top_10pct_full_count_share, round(fg, 6) AS gini_full_count_output, round(mean_refs, 6) AS mean_referenced_works,
       round(CAST(med_refs AS DOUBLE), 6) AS median_referenced_works, round(n_refs / n, 6) AS reference_coverage_share, round(trunc, 6) AS truncated_authorship_paper_share,
       round(known, 6) AS authorship_coverage_known_share, round(comp, 6) AS complete_authorship_paper_share, round(slots, 6) AS missing_author_id_slot_share
FROM c JOIN b USING (year, scope)
"""


def concentration_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.annual_metrics(papers(spark, sf_dir), minimum_lookback=LOOKBACK, subfields=False))


def concentration_by_subfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.annual_metrics(papers(spark, sf_dir), minimum_lookback=LOOKBACK, overall=False))


def concentration_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.annual_metrics(papers(spark, sf_dir), minimum_lookback=LOOKBACK, subfields=False, require_complete=True))


def load_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.diagnostics(papers(spark, sf_dir))


def entry_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by the year of their first work."""
    return C.first_years(papers(spark, sf_dir)).groupBy(F.col("first_year").alias("year")).agg(F.count(F.lit(1)).alias("new_authors"))


def team_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = papers(spark, sf_dir).select("year", F.size("authors").cast("long").alias("team_size"))
    return own.groupBy("year", "team_size").agg(F.count(F.lit(1)).alias("n"))


def indexed_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by year, the first year being 100."""
    years = papers(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return rounded(years.withColumn("index", C.indexed(years, "year", "n")))


def subfields_of_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by subfield, each counted once in all subfields of its works."""
    own = papers(spark, sf_dir).select("subfield", F.explode("authors").alias("author")).groupBy("author").agg(F.collect_set("subfield").alias("subfields"))
    return multi_counts(own, "subfields", "none")


def refused_authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail validation, by reason; years are shifted so that some do."""
    rows = authorships(spark, sf_dir).withColumns({"year": F.when(F.col("work_id") % 5 == 0, F.col("year") + 105).otherwise(F.col("year")), "author_id": F.col("author_id").cast("string"), "work_id": F.col("work_id").cast("string")})
    return rows.withColumn("problem", authorship_problem()).where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (concentration_annual, concentration_by_subfield, concentration_complete, load_diagnostics, entry_cohorts, team_size, indexed_growth, subfields_of_authors, refused_authorships)}
ORACLE_SQL = {
    "concentration_annual": _metrics_sql("'all'"),
    "concentration_by_subfield": _metrics_sql("'subfield:' || subfield"),
    "concentration_complete": _metrics_sql("'all'", "complete"),
    "load_diagnostics": _BASE + """SELECT CAST(sum(n_rows) AS BIGINT) AS input_rows, CAST(sum(n_rows - size) AS BIGINT) AS duplicate_authorship_rows,
        count(*) FILTER (trunc) AS papers_with_truncated_authorships, count(*) FILTER (total IS NOT NULL AND missing IS NOT NULL) AS papers_with_known_authorship_coverage,
        count(*) FILTER (missing > 0) AS papers_with_missing_author_ids FROM p""",
    "entry_cohorts": _BASE + "SELECT CAST(first_year AS BIGINT) AS year, count(*) AS new_authors FROM fy GROUP BY 1",
    "team_size": _BASE + "SELECT CAST(year AS BIGINT) AS year, size AS team_size, count(*) AS n FROM p GROUP BY ALL",
    "indexed_growth": _BASE + ", y AS (SELECT year, count(*) AS n FROM p GROUP BY year) SELECT CAST(year AS BIGINT) AS year, n, round(100e0 * n / first_value(n) OVER (ORDER BY year), 6) AS index FROM y",
    "subfields_of_authors": "SELECT o_orderpriority AS value, count(DISTINCT l_suppkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "refused_authorships": """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) + CASE WHEN o_orderkey % 5 = 0 THEN 105 ELSE 0 END > 2100
        THEN 'publication_year is out of range' END AS problem FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE problem IS NOT NULL GROUP BY 1""",
}
