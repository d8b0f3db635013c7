"""Two runs over the same papers, side by side, by any strata and their totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio

#: What stands for a stratum that neither run tells.
UNKNOWN = "unknown"
COUNTS = ("common", "positive_one", "positive_two", "both", "only_one", "only_two", "neither", "missing_in_two", "missing_in_one", "missing_in_two_positive", "missing_in_one_positive")


def _papers(run: DataFrame, key: str, positive: str, dims: Sequence[str], side: str) -> DataFrame:
    """One row of each paper of a run."""
    told = [F.min(F.col(d).cast("string")).alias(f"{d}_{side}") for d in dims]
    return run.where(F.col(key).isNotNull()).groupBy(key).agg(F.coalesce(F.bool_or(positive), F.lit(False)).alias(f"_{side}"), *told)


def side_by_side(one: DataFrame, two: DataFrame, key: str, positive: str, dims: Sequence[str]) -> DataFrame:
    """key, the strata, in_one, in_two, one, two of every paper of either run: whether it is there, and whether it is positive.

    A paper's stratum is that of the first run, or of the second where the first
    has none. Repeated rows of a paper are one, positive if any is; rows without
    a key are left out; a null is not positive.
    """
    met = _papers(one, key, positive, dims, "one").join(_papers(two, key, positive, dims, "two"), key, "full_outer")
    strata = [F.coalesce(f"{d}_one", f"{d}_two", F.lit(UNKNOWN)).alias(d) for d in dims]
    here = lambda side: F.col(f"_{side}").isNotNull().alias(f"in_{side}")
    yes = lambda side: F.coalesce(f"_{side}", F.lit(False)).alias(side)
    return met.select(key, *strata, here("one"), here("two"), yes("one"), yes("two"))


def compare_cube(one: DataFrame, two: DataFrame, key: str, positive: str, dims: Sequence[str], sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """dims (null where summed up), level, counts and rates of two runs for each of the grouping ``sets`` (all, as a cube, by default).

    ``level`` has a bit for each stratum that is summed up, the last one lowest;
    it tells a total from a stratum. Papers of both runs are ``common``: positive
    in either, in both, in one only, in neither; rates are over these. Papers
    of one run alone are counted apart, never dropped. Counts by stratum and
    outcome are few; only these are multiplied by the sets.
    """
    rows = side_by_side(one, two, key, positive, dims).groupBy(*dims, "in_one", "in_two", "one", "two").agg(F.count(F.lit(1)).alias("n"))
    common, a, b = F.col("in_one") & F.col("in_two"), F.col("one"), F.col("two")
    when = {
        "common": common, "positive_one": common & a, "positive_two": common & b, "both": common & a & b, "only_one": common & a & ~b, "only_two": common & ~a & b, "neither": common & ~a & ~b,
        "missing_in_two": ~F.col("in_two"), "missing_in_one": ~F.col("in_one"), "missing_in_two_positive": ~F.col("in_two") & a, "missing_in_one_positive": ~F.col("in_one") & b,
    }
    rows = rows.select(*dims, *[F.when(when[c], F.col("n")).otherwise(0).alias(c) for c in COUNTS])
    grouped = rows.cube(*dims) if sets is None else rows.groupingSets([list(s) for s in sets], *dims)
    told = grouped.agg(F.grouping_id().cast("int").alias("level"), *[F.sum(c).alias(c) for c in COUNTS])
    rate = lambda k: ratio(F.col(k), F.col("common"))
    return told.withColumns({"rate_one": rate("positive_one"), "rate_two": rate("positive_two"), "difference": rate("positive_one") - rate("positive_two"), "agreement": ratio(F.col("both") + F.col("neither"), F.col("common"))})


def disagreements(one: DataFrame, two: DataFrame, key: str, positive: str, dims: Sequence[str] = ()) -> DataFrame:
    """key, the strata and outcome (only_one, only_two, missing_in_one, missing_in_two) of the papers on which two runs differ."""
    outcome: Column = F.when(~F.col("in_two"), "missing_in_two").when(~F.col("in_one"), "missing_in_one").when(F.col("one") & ~F.col("two"), "only_one").when(~F.col("one") & F.col("two"), "only_two")
    return side_by_side(one, two, key, positive, dims).withColumn("outcome", outcome).where("outcome IS NOT NULL").select(key, *dims, "outcome")
