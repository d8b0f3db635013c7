"""Rates over time and strata, day grids, and the folding of small or many cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import rate_columns

#: Least rows of a reported cell, and of the rest that is not told apart.
WEEK_FLOOR, SUBFIELD_FLOOR, SERIES_FLOOR, PRIVACY_FLOOR, CHART_TOP = 200, 100, 1000, 3, 12
OTHER, OTHER_SMALL = "Other", "other (<3 each)"


def bucket(day: Column, grain: str) -> Column:
    """The day, its Monday, or its month as text."""
    if grain == "month":
        return F.date_format(day, "yyyy-MM")
    return F.date_format(F.date_trunc("week", day) if grain == "week" else day, "yyyy-MM-dd")


def rate_series(rows: DataFrame, keys: dict[str, Column], positive: Column, floor: int = 0) -> DataFrame:
    """n, a, rate and Wilson bounds of ``positive`` by the keys, for cells of at least ``floor`` rows."""
    told = rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count(F.lit(1)).alias("_n"), F.count_if(positive).alias("_k"))
    return told.where(F.col("_n") >= floor).select(*keys, *rate_columns(F.col("_k"), F.col("_n")))


def rate_cube(rows: DataFrame, day: Column, stratum: Column, positive: Column, floor: int) -> DataFrame:
    """Daily, weekly and monthly series of all rows, and monthly ones of strata of at least ``floor`` rows.

    One aggregation by (day, stratum) serves all series.
    """
    base = rows.groupBy(F.to_date(day).alias("day"), stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.count_if(positive).alias("k"))
    large = base.groupBy("stratum").agg(F.sum("n").alias("total")).where(F.col("total") >= floor).select("stratum")
    parts = [base.select(F.lit(g).alias("grain"), F.lit("All").alias("stratum"), bucket(F.col("day"), g).alias("bucket"), "n", "k") for g in ("day", "week", "month")]
    parts.append(base.join(large, "stratum", "left_semi").select(F.lit("month").alias("grain"), "stratum", bucket(F.col("day"), "month").alias("bucket"), "n", "k"))
    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part)
    told = told.groupBy("grain", "stratum", "bucket").agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"))
    return told.select("grain", "stratum", "bucket", *rate_columns(F.col("_k"), F.col("_n")))


def day_grid(rows: DataFrame, day: Column, category: Column) -> DataFrame:
    """(day, category, n) for every day between the first and last and every category, zeros too."""
    counts = rows.groupBy(F.to_date(day).alias("day"), category.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    # Both lists are short, days of a span and categories of a vocabulary, and come from one row.
    ends = counts.agg(F.sequence(F.min("day"), F.max("day"), F.expr("INTERVAL 1 DAY")).alias("days"), F.collect_set("category").alias("categories"))
    spine = ends.select(F.explode("days").alias("day"), "categories").select("day", F.explode("categories").alias("category"))
    return spine.join(counts, ["day", "category"], "left").select("day", "category", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def complete_weeks(grid: DataFrame) -> DataFrame:
    """Counts of Monday weeks that the grid holds in full."""
    weeks = grid.groupBy(F.date_trunc("week", "day").cast("date").alias("week"), "category").agg(F.sum("n").alias("n"), F.count_distinct("day").alias("days"))
    return weeks.where("days = 7").drop("days")


def rebucket(grid: DataFrame, grain: str, top: int = 8) -> DataFrame:
    """(series, bucket, n) of a day grid: the total, the ``top`` largest categories (ties by name), and the others as one.

    Weeks and months count only where the grid holds all their days.
    """
    best = grid.groupBy("category").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "category").limit(top).select(F.col("category").alias("_best"))
    told = grid.join(F.broadcast(best), F.col("category") == F.col("_best"), "left").withColumn("series", F.explode(F.array(F.lit("TOTAL"), F.coalesce("_best", F.lit("OTHER")))))
    days = {"week": F.lit(7), "month": F.dayofmonth(F.last_day("day"))}.get(grain, F.lit(1))
    cells = told.groupBy("series", bucket(F.col("day"), grain).alias("bucket")).agg(F.sum("n").alias("n"), F.count_distinct("day").alias("_days"), F.max(days).alias("_all"))
    return cells.where("_days = _all").drop("_days", "_all")


def rolling_pair(rows: DataFrame, day: Column, last: Column, span: int = 28, back: int = 364) -> DataFrame:
    """Rows of the ``span`` days up to ``last``, of the same window ``back`` days earlier, and the change in percent."""
    age = F.date_diff(last, F.to_date(day))
    now, before = F.count_if((age >= 0) & (age < span)), F.count_if((age >= back) & (age < back + span))
    told = rows.agg(now.alias("current"), before.alias("prior"))
    return told.withColumn("change_pct", F.round(100.0 * (F.col("current") - F.col("prior")) / F.nullif("prior", F.lit(0)), 1))


def fold_small(cells: DataFrame, name: str, n: str, floor: int = PRIVACY_FLOOR) -> DataFrame:
    """Cells under the floor become one."""
    told = F.when(F.col(n) < floor, F.lit(OTHER_SMALL)).otherwise(F.col(name))
    return cells.groupBy(told.alias(name)).agg(F.sum(n).alias(n))


def fold_rest(cells: DataFrame, name: str, n: str, top: int = CHART_TOP) -> DataFrame:
    """All but the ``top`` largest cells (ties by name) become one; the top is found without sorting the rest."""
    best = cells.orderBy(F.desc(n), name).limit(top).select(F.col(name).alias("_name"))
    told = cells.join(F.broadcast(best), F.col(name) == F.col("_name"), "left")
    return told.groupBy(F.when(F.col("_name").isNull(), F.lit(OTHER)).otherwise(F.col(name)).alias(name)).agg(F.sum(n).alias(n))


def multi_counts(rows: DataFrame, values: str, default: str) -> DataFrame:
    """Rows by each value of an array column; rows without any count for the default."""
    held = F.coalesce(F.size(values), F.lit(0)) > 0
    return rows.select(F.explode(F.when(held, F.array_distinct(values)).otherwise(F.array(F.lit(default)))).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def horizons(rows: DataFrame, day: Column, last: Column, spans: dict[str, int]) -> DataFrame:
    """Each row once for every horizon (days back from ``last``, 0 for all) that holds it."""
    inside = [F.when(F.lit(d == 0) | (F.to_date(day) >= F.date_sub(last, d)), F.lit(name)) for name, d in spans.items()]
    return rows.withColumn("horizon", F.explode(F.array_compact(F.array(*inside))))


def ranked(cells: DataFrame, name: str, n: str, by: list[str], top: int) -> DataFrame:
    """The ``top`` cells of each group, ties by name."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(n), name))
    return cells.withColumn("rank", rank).where(F.col("rank") <= top)
