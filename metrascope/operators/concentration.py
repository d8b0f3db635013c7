"""Participation and concentration of authorship by year and scope.

The input has one row per paper and author. Papers are rebuilt with one shuffle
by work; outputs of authors take a second by (year, scope, author); rankings for
Gini and top shares a window by (year, scope). A year's authors can be many, so
these windows are replaced by sums over ranks of distinct outputs: authors with
equal outputs are interchangeable, and distinct outputs few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..workspace import Workspace

#: Columns of the metrics table, in order.
FIELDS = [
    "year", "scope", "n_papers_frame", "n_papers", "n_active_authors", "fractional_output_per_author", "new_author_share",
    "early_career_share_0_3", "median_observed_math_age", "left_censored_author_share", "solo_paper_share", "team_3plus_share",
    "mean_team_size", "median_team_size", "top_1pct_fractional_share", "top_5pct_fractional_share", "top_10pct_fractional_share",
    "gini_fractional_output", "top_10pct_full_count_share", "gini_full_count_output", "mean_referenced_works",
    "median_referenced_works", "reference_coverage_share", "truncated_authorship_paper_share", "authorship_coverage_known_share",
    "complete_authorship_paper_share", "missing_author_id_slot_share",
]

#: Columns in which all rows of a work have to agree.
SIGNATURE = ["arxiv_id", "year", "month", "subfield", "references", "total", "missing"]


def rebuild_papers(rows: DataFrame) -> DataFrame:
    """One row per work: signature columns, truncated, authors (sorted, distinct), input rows."""
    same = F.count_distinct(F.struct(*SIGNATURE))
    papers = rows.groupBy("work_id").agg(
        *[F.first(c).alias(c) for c in SIGNATURE], F.bool_or("truncated").alias("truncated"),
        F.sort_array(F.collect_set("author_id")).alias("authors"), F.count(F.lit(1)).alias("n_rows"), same.alias("_signatures"))
    wrong = F.raise_error(F.concat(F.lit("inconsistent metadata for work "), F.col("work_id").cast("string")))
    return papers.where(F.when(F.col("_signatures") == 1, True).otherwise(wrong.cast("boolean"))).drop("_signatures")


def diagnostics(papers: DataFrame) -> DataFrame:
    return papers.agg(
        F.sum("n_rows").alias("input_rows"),
        F.sum(F.col("n_rows") - F.size("authors")).alias("duplicate_authorship_rows"),
        F.count_if("truncated").alias("papers_with_truncated_authorships"),
        F.count_if(F.col("total").isNotNull() & F.col("missing").isNotNull()).alias("papers_with_known_authorship_coverage"),
        F.count_if(F.coalesce("missing", F.lit(0)) > 0).alias("papers_with_missing_author_ids"),
    )


def first_years(papers: DataFrame) -> DataFrame:
    """(author, first_year) over all papers, whatever their scope."""
    return papers.select("year", F.explode("authors").alias("author")).groupBy("author").agg(F.min("year").alias("first_year"))


def complete() -> Column:
    return F.coalesce(F.col("total").isNotNull() & (F.col("missing") == 0) & ~F.col("truncated"), F.lit(False))


def inequality(outputs: DataFrame, keys: list[str], measures: dict[str, tuple[str, dict[str, float]]]) -> DataFrame:
    """Gini and top shares over the rows of each key.

    ``measures``: value column -> (name of its Gini, names and proportions of
    its top shares). Equal values become one row with a count; running counts
    over these rows stand for ranks. All measures share one shuffle.
    """
    each = F.array(*[F.struct(F.lit(v).alias("measure"), F.round(v, 9).alias("x")) for v in measures])
    levels = outputs.select(*keys, F.explode(each).alias("e")).groupBy(*keys, "e.measure", "e.x").agg(F.count(F.lit(1)).cast("double").alias("m"))
    own = [*keys, "measure"]
    up = W.partitionBy(*own).orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*own)
    levels = levels.withColumns({"upto": F.sum("m").over(up), "n": F.sum("m").over(whole), "total": F.sum(F.col("m") * F.col("x")).over(whole)})
    of = lambda v, c: F.when(F.col("measure") == v, c)
    whole_of = lambda v: F.nullif(F.max(of(v, F.col("total"))), F.lit(0.0))
    told = []
    for v, (gini, shares) in measures.items():
        # Ranks of a level run from upto - m + 1 to upto; the sum of 2 i - n - 1 over them is m (2 upto - m - n).
        weighted = F.sum(of(v, F.col("x") * F.col("m") * (2 * F.col("upto") - F.col("m") - F.col("n"))))
        told.append(F.coalesce(weighted / (F.max(of(v, F.col("n"))) * whole_of(v)), F.lit(0.0)).alias(gini))
        for name, p in shares.items():
            # Of the k authors on top, a level gives those that higher levels leave.
            k = F.greatest(F.lit(1.0), F.ceil(F.lit(p).cast("double") * F.col("n")).cast("double"))
            taken = F.greatest(F.lit(0.0), F.least(F.col("m"), k - (F.col("n") - F.col("upto"))))
            told.append(F.coalesce(F.sum(of(v, taken * F.col("x"))) / whole_of(v), F.lit(0.0)).alias(name))
    return levels.groupBy(*keys).agg(*told)


def annual_metrics(papers: DataFrame, start: int | None = None, end: int | None = None, minimum_lookback: int = 5, subfields: bool = True, require_complete: bool = False, overall: bool = True) -> DataFrame:
    """The metrics of ``FIELDS`` per year and scope (``all``, ``subfield:...``).

    With ``require_complete`` only papers whose authors are all known are
    analysed; columns on coverage still describe the whole frame. First years
    of authors come from all papers.
    """
    papers = Workspace(papers.sparkSession, "concentration").save(papers, "papers")  # four branches read the rebuilt papers
    span = papers.agg(F.min("year").alias("low"), F.max("year").alias("high")).first()
    start = span.low + minimum_lookback if start is None else start
    end = span.high if end is None else end
    if end < start or start - span.low < minimum_lookback:
        raise ValueError(f"only {start - span.low} lookback years; at least {minimum_lookback} required")
    scopes = [F.lit("all")] * overall + [F.concat(F.lit("subfield:"), F.col("subfield"))] * subfields
    chosen = papers.where(F.col("year").between(start, end)).withColumn("scope", F.explode(F.array(*scopes)))
    chosen = chosen.withColumns({"size": F.size("authors"), "analysed": complete() if require_complete else F.lit(True), "complete": complete()})
    keys, inside = ["year", "scope"], F.col("analysed")
    known = F.col("total").isNotNull() & F.col("missing").isNotNull()
    of = lambda c: F.when(inside, c)
    n = F.count_if(inside)
    by_paper = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_papers_frame"), n.alias("n_papers"),
        ratio(F.count_if(inside & (F.col("size") == 1)), n).alias("solo_paper_share"),
        ratio(F.count_if(inside & (F.col("size") >= 3)), n).alias("team_3plus_share"),
        F.avg(of(F.col("size"))).alias("mean_team_size"), F.median(of(F.col("size"))).alias("median_team_size"),
        F.avg(of(F.col("references"))).alias("mean_referenced_works"), F.median(of(F.col("references"))).alias("median_referenced_works"),
        ratio(F.count(of(F.col("references"))), n).alias("reference_coverage_share"),
        ratio(F.count_if(inside & F.col("truncated")), n).alias("truncated_authorship_paper_share"),
        ratio(F.count_if(known), F.count(F.lit(1))).alias("authorship_coverage_known_share"),
        ratio(F.count_if("complete"), F.count(F.lit(1))).alias("complete_authorship_paper_share"),
        ratio(F.sum(F.coalesce("missing", F.lit(0))), F.sum(F.coalesce("total", F.lit(0)))).alias("missing_author_id_slot_share"),
    ).where("n_papers > 0")

    credit = chosen.where(inside).select(*keys, F.explode("authors").alias("author"), (F.lit(1.0) / F.col("size")).alias("part"))
    outputs = credit.groupBy(*keys, "author").agg(F.sum("part").alias("fractional"), F.count(F.lit(1)).cast("double").alias("full"))
    age = F.col("year") - F.col("first_year")
    m = F.count(F.lit(1))
    by_author = outputs.join(first_years(papers), "author").groupBy(*keys).agg(
        m.alias("n_active_authors"), ratio(F.count_if(age == 0), m).alias("new_author_share"),
        ratio(F.count_if(age <= 3), m).alias("early_career_share_0_3"), F.median(age).alias("median_observed_math_age"),
        ratio(F.count_if(F.col("first_year") == span.low), m).alias("left_censored_author_share"))
    tops = {f"top_{round(100 * p)}pct_fractional_share": p for p in (0.01, 0.05, 0.10)}
    unequal = inequality(outputs, keys, {"fractional": ("gini_fractional_output", tops), "full": ("gini_full_count_output", {"top_10pct_full_count_share": 0.10})})
    joined = by_paper.join(by_author, keys).join(unequal, keys)
    return joined.withColumn("fractional_output_per_author", ratio(F.col("n_papers"), F.col("n_active_authors"))).select(*FIELDS)


def indexed(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> Column:
    """100 x value / first value that is neither null nor zero."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return 100 * F.col(value) / F.first(F.nullif(F.col(value).cast("double"), F.lit(0.0)), ignorenulls=True).over(w)
