"""Rates over time and strata: an event is positive if it is a purchase."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prevalence as P
from ..streaming import weekly
from .common import rate_sql, rounded, table

_DAY, _WEEK, _MONTH = "strftime(ts, '%Y-%m-%d')", "strftime(date_trunc('week', ts), '%Y-%m-%d')", "strftime(ts, '%Y-%m')"
_RATE = rate_sql("count(*) FILTER (event_type = 'purchase')", "count(*)")


def _series(spark: SparkSession, sf_dir: str, floor: int = 0, **keys) -> DataFrame:
    return P.rate_series(table(spark, sf_dir, "events"), keys, F.col("event_type") == "purchase", floor)


def prevalence_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, bucket=P.bucket(F.col("ts"), "day"))


def prevalence_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, P.WEEK_FLOOR, bucket=P.bucket(F.col("ts"), "week"))


def prevalence_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, bucket=P.bucket(F.col("ts"), "month"))


def prevalence_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week and hour of day."""
    return _series(spark, sf_dir, bucket=P.bucket(F.col("ts"), "week"), stratum=F.hour("ts").cast("long"))


def subfield_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By hour of day, where there are enough events."""
    return _series(spark, sf_dir, P.SUBFIELD_FLOOR, subfield=F.hour("ts").cast("long"))


def rate_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rate_cube(table(spark, sf_dir, "events"), F.col("ts"), (F.col("user_id") % 8).cast("string"), F.col("event_type") == "purchase", P.SERIES_FLOOR)


def rolling_4w_vs_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the last four weeks of the table against the same weeks a year before."""
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderdate").alias("last")).first()["last"]
    return rounded(P.rolling_pair(orders, F.col("o_orderdate"), F.to_date(F.lit(last))))


def day_category_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = P.day_grid(table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("ts"), (F.col("user_id") % 20).cast("string"))
    return grid.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def complete_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = P.complete_weeks(P.day_grid(table(spark, sf_dir, "events"), F.col("ts"), F.col("event_type")))
    return weeks.withColumn("week", F.date_format("week", "yyyy-MM-dd"))


def privacy_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by user and day; cells with few fold into one."""
    name = F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"))
    cells = table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return P.fold_small(cells, "name", "n")


def chart_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return P.fold_rest(cells, "name", "n")


def top_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 suppliers with most items of each return flag, ties by key."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_suppkey").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return P.ranked(cells, "name", "n", ["l_returnflag"], 25).withColumn("rank", F.col("rank").cast("long"))


def horizon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status in three horizons that end with the table's last day."""
    orders = table(spark, sf_dir, "orders")
    last = F.to_date(F.lit(orders.agg(F.max("o_orderdate")).first()[0]))
    told = P.horizons(orders, F.col("o_orderdate"), last, {"all": 0, "year": 365, "quarter": 92})
    return told.groupBy("horizon", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def rebucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by user group: total, the eight largest groups and the others, by day, complete week and complete month."""
    grid = P.day_grid(table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("ts"), (F.col("user_id") % 20).cast("string"))
    told = [P.rebucket(grid, g).withColumn("grain", F.lit(g)) for g in ("day", "week", "month")]
    return told[0].unionByName(told[1]).unionByName(told[2])


def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly rates, computed by a stream over the events."""
    return weekly.weekly_rates(spark, f"{sf_dir}/events.parquet")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of four weeks that begin every Monday, computed by a stream."""
    told = weekly.run_to_table(weekly.sliding_totals(weekly.event_stream(spark, f"{sf_dir}/events.parquet")))
    return told.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


QUERIES = {f.__name__: f for f in (prevalence_daily, prevalence_weekly, prevalence_monthly, prevalence_by_stratum, subfield_rates, rate_cube, rolling_4w_vs_prior, day_category_grid, complete_weeks, privacy_floor, chart_fold, top_counters, horizon_counts, rebucketed, stream_weekly, stream_sliding)}
ORACLE_SQL = {
    "prevalence_daily": f"SELECT {_DAY} AS bucket, {_RATE} FROM events GROUP BY 1",
    "prevalence_weekly": f"SELECT {_WEEK} AS bucket, {_RATE} FROM events GROUP BY 1 HAVING count(*) >= 200",
    "prevalence_monthly": f"SELECT {_MONTH} AS bucket, {_RATE} FROM events GROUP BY 1",
    "prevalence_by_stratum": f"SELECT {_WEEK} AS bucket, hour(ts) AS stratum, {_RATE} FROM events GROUP BY 1, 2",
    "subfield_rates": f"SELECT hour(ts) AS subfield, {_RATE} FROM events GROUP BY 1 HAVING count(*) >= 100",
    "rate_cube": f"""SELECT 'day' AS grain, 'All' AS stratum, {_DAY} AS bucket, {_RATE} FROM events GROUP BY 3
        UNION ALL SELECT 'week', 'All', {_WEEK} AS bucket, {_RATE} FROM events GROUP BY 3 UNION ALL SELECT 'month', 'All', {_MONTH} AS bucket, {_RATE} FROM events GROUP BY 3
        UNION ALL SELECT 'month', CAST(user_id % 8 AS VARCHAR) AS stratum, {_MONTH} AS bucket, {_RATE} FROM events
                  WHERE user_id % 8 IN (SELECT user_id % 8 FROM events GROUP BY 1 HAVING count(*) >= 1000) GROUP BY 2, 3""",
    "rolling_4w_vs_prior": """WITH d AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST((SELECT max(o_orderdate) FROM orders) AS DATE)) AS age FROM orders),
        c AS (SELECT count(*) FILTER (age >= 0 AND age < 28) AS current, count(*) FILTER (age >= 364 AND age < 392) AS prior FROM d)
        SELECT current, prior, round(100e0 * (current - prior) / nullif(prior, 0), 1) AS change_pct FROM c""",
    "day_category_grid": """WITH e AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 20 AS VARCHAR) AS category FROM events WHERE event_type = 'error'),
        d AS (SELECT unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS day FROM e)
        SELECT strftime(d.day, '%Y-%m-%d') AS day, c.category, count(e.day) AS n FROM d CROSS JOIN (SELECT DISTINCT category FROM e) c
        LEFT JOIN e ON e.day = CAST(d.day AS DATE) AND e.category = c.category GROUP BY 1, 2""",
    "complete_weeks": """WITH x AS (SELECT date_trunc('week', ts) AS w, event_type, CAST(ts AS DATE) AS d FROM events),
        full_weeks AS (SELECT date_trunc('week', d) AS w FROM (SELECT unnest(range(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM events) GROUP BY 1 HAVING count(*) = 7)
        SELECT strftime(x.w, '%Y-%m-%d') AS week, event_type AS category, count(*) AS n FROM x JOIN full_weeks USING (w) GROUP BY 1, 2""",
    "privacy_floor": """WITH c AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS name, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1)
        SELECT CASE WHEN n < 3 THEN 'other (<3 each)' ELSE name END AS name, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "chart_fold": """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS r FROM c)
        SELECT CASE WHEN r > 12 THEN 'Other' ELSE name END AS name, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1""",
    "top_counters": """WITH c AS (SELECT l_returnflag, l_suppkey AS name, count(*) AS n FROM lineitem GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, name) AS rank FROM c QUALIFY rank <= 25""",
    "horizon_counts": """WITH l AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders), h(horizon, days) AS (VALUES ('all', 0), ('year', 365), ('quarter', 92))
        SELECT horizon, o_orderstatus, count(*) AS n FROM orders, l, h WHERE days = 0 OR CAST(o_orderdate AS DATE) >= last - days GROUP BY 1, 2""",
    "rebucketed": f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, CAST(user_id % 20 AS VARCHAR) AS category FROM events WHERE event_type = 'error'),
        d AS (SELECT CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM e),
        t AS (SELECT category FROM e GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 8),
        s AS (SELECT day, 'TOTAL' AS series FROM e UNION ALL SELECT day, CASE WHEN category IN (FROM t) THEN category ELSE 'OTHER' END FROM e),
        g AS (SELECT d.day, n.series, count(s.day) AS n FROM d CROSS JOIN (SELECT DISTINCT series FROM s) n LEFT JOIN s ON s.day = d.day AND s.series = n.series GROUP BY 1, 2)
        SELECT 'day' AS grain, series, strftime(day, '%Y-%m-%d') AS bucket, n FROM g
        UNION ALL SELECT 'week', series, strftime(date_trunc('week', day), '%Y-%m-%d'), CAST(sum(n) AS BIGINT) FROM g GROUP BY 2, 3 HAVING count(*) = 7
        UNION ALL SELECT 'month', series, strftime(day, '%Y-%m'), CAST(sum(n) AS BIGINT) FROM g GROUP BY 2, 3 HAVING count(*) = max(day(last_day(day)))""",
    "stream_sliding": """SELECT strftime(CAST(date_trunc('week', ts) AS DATE) - 7 * back, '%Y-%m-%d') AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS back) GROUP BY 1""",
    "stream_weekly": f"SELECT {_WEEK} AS bucket, {_RATE} FROM events GROUP BY 1",
}
