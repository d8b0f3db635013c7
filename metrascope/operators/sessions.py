"""Operators that depend on order: gap sessions, anchored blocks, unions of intervals, picks and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace
from .numbering import numbered

#: Characters after which a new snippet, and a new excerpt, begins; items of a batch.
MERGE_GAP, EXCERPT_SPAN, BATCH = 600, 3000, 30


def gap_sessions(rows: DataFrame, keys: list[str], order: str, gap: Column | int, tie: str | None = None, session: str = "session") -> DataFrame:
    """``session``: number of the chain, within the keys, that a row belongs to.

    A chain goes on while the distance to the row before is at most ``gap``.
    """
    w = W.partitionBy(*keys).orderBy(order, *([tie] if tie else []))
    opens = F.when(F.col(order) - F.lag(order).over(w) <= gap, 0).otherwise(1)
    return rows.withColumn("_opens", opens).withColumn(session, F.sum("_opens").over(w)).drop("_opens")


def merge_snippets(hits: DataFrame, keys: list[str], gap: int = MERGE_GAP) -> DataFrame:
    """Snippets from hits (id, term, offset, context): sorted terms, ids in order of offset, longest context (first of ties)."""
    chained = gap_sessions(hits, keys, "offset", gap, "id")
    return chained.groupBy(*keys, "session").agg(
        F.sort_array(F.collect_set("term")).alias("terms"),
        F.transform(F.sort_array(F.collect_list(F.struct("offset", "id"))), lambda x: x["id"]).alias("hit_ids"),
        F.max_by("context", F.struct(F.length("context"), -F.col("offset"), -F.col("id"))).alias("context"),
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"))


def anchored_blocks(rows: DataFrame, keys: list[str], low: str, span: int = EXCERPT_SPAN) -> DataFrame:
    """(keys, block_low, block_high, n): rows join the block before them while within ``span`` of its start.

    Other than in a chain, the distance counts from the block's first row, which
    a window cannot look back to: an ordered fold over each key's positions does.
    """
    places = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(low).cast("long"))).alias("_at"))
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<low: BIGINT, high: BIGINT, n: BIGINT>>)")
    one = lambda x: F.struct(x.alias("low"), x.alias("high"), F.lit(1).cast("long").alias("n"))

    def add(state: Column, x: Column) -> Column:
        open_ = state["open"]
        joins = open_.isNotNull() & (x - open_["low"] < span)
        longer = F.struct(open_["low"].alias("low"), x.alias("high"), (open_["n"] + 1).alias("n"))
        done = F.when(joins | open_.isNull(), state["done"]).otherwise(F.array_append(state["done"], open_))
        return F.struct(done.alias("done"), F.when(joins, longer).otherwise(one(x)).alias("open"))

    start = F.struct(empty.alias("done"), F.expr("CAST(NULL AS STRUCT<low: BIGINT, high: BIGINT, n: BIGINT>)").alias("open"))
    blocks = F.aggregate("_at", start, add, lambda s: F.array_append(s["done"], s["open"]))
    return places.select(*keys, F.explode(blocks).alias("b")).select(*keys, F.col("b.low").alias("block_low"), F.col("b.high").alias("block_high"), F.col("b.n").alias("n"))


def interval_union(rows: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Unions of intervals that overlap or touch."""
    w = W.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col(low) <= reach, 0).otherwise(1)
    numbered = rows.withColumn("_opens", opens).withColumn("_block", F.sum("_opens").over(w))
    return numbered.groupBy(*keys, "_block").agg(F.min(low).alias(low), F.max(high).alias(high), F.count(F.lit(1)).alias("n")).drop("_block")


def pick_first(rows: DataFrame, keys: list[str], *order: Column | str, k: int = 1) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, as an upsert leaves it; an aggregation with partial results, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    told = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return told.select(*keys, "_r.*").select(*rows.columns)


def settle(rows: DataFrame, keys: list[str], status: str, order: str) -> DataFrame:
    """One row for each key: the first that is ok, or else the first of all."""
    return latest(rows, keys, F.struct((F.col(status) == "ok").cast("int"), -F.col(order)))


def batches(rows: DataFrame, keys: list[str], order: list[str], size: int = BATCH) -> DataFrame:
    """``batch``: number of the run of ``size`` rows within the keys; a key of any share of the rows is numbered by all tasks."""
    told = numbered(rows, order, Workspace(rows.sparkSession, "batches"), "rows", keys, "_number")
    return told.withColumn("batch", F.floor((F.col("_number") - 1) / size)).drop("_number")
