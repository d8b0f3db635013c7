"""Numbers of rows in an order, whole or group by group, that no single task has to count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace, shuffle_partitions

#: Ranges of groups that are broadcast, at most.
FEW = 50_000


def numbered(rows: DataFrame, order: Sequence[Column | str], work: Workspace, table: str, within: Sequence[str] = (), number: str = "number") -> DataFrame:
    """``rows`` and, in ``number``, 1, 2, 3... in the order, anew for each value of the columns ``within``.

    Rows are sorted over ranges of (``within``, ``order``) and written with their
    places; a row for each range and group in it tells how many came before. A
    group of any size spreads over as many ranges as it needs, and no window
    holds one: that of the offsets has a row for each range of a group. The
    order should be total: rows that it cannot tell apart stay in one range.

    Nulls in ``within`` make a group of their own; without rows there are none.
    """
    keys = [*within, *order]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    held = work.save(dealt.withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)), table)
    ends = held.groupBy("_range", *within).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(within or [F.lit(1)])).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if within:
        # Few ranges and groups go to the rows, so that these are not shuffled again.
        ends = work.save(ends, f"{table}-ends")
        if ends.limit(FEW + 1).count() <= FEW:
            ends = F.broadcast(ends)
        own = ends.withColumnsRenamed({c: f"_of_{k}" for k, c in enumerate(within)} | {"_range": "_of_range"})
        same = F.col("_range") == F.col("_of_range")
        for k, c in enumerate(within):
            same &= F.col(c).eqNullSafe(F.col(f"_of_{k}"))
        met = held.join(own, same)
    else:
        met = held.join(F.broadcast(ends), "_range")  # a row for each range
    return met.select(*rows.columns, (F.col("_place") - F.col("_first") + F.col("_before") + 1).alias(number))
