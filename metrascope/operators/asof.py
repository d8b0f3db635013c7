"""As-of joins of two tables of positions: for each point, the last mark at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import Workspace, shuffle_partitions


def last_before(points: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, mark_at: str, values: Sequence[str], work: Workspace, table: str, within: int | None = None, distance: str = "distance") -> DataFrame:
    """``points`` with the ``values`` of the last mark of the same keys at or before, and how far it is; null without one.

    Points and marks are sorted together over ranges of (keys, place) and
    written; a row for each range of a key then carries its last mark on to the
    later ones. So a key of any number of rows spreads over as many ranges as it
    needs, and no window holds more than a range of it. With ``within``, marks
    farther away do not count. Of marks at one place the greatest values win;
    null keys are a key like others; points and marks without a place have no
    order and meet nothing.
    """
    mark = F.struct(F.col(mark_at).alias("at"), *[F.col(v).alias(f"v{k}") for k, v in enumerate(values)])
    none = F.lit(None).cast(marks.select(mark.alias("m")).schema["m"].dataType)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = points.select(*named, F.col(at).alias("_at"), F.lit(1).alias("_kind"), none.alias("_mark"), F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point"))
    told = marks.where(F.col(mark_at).isNotNull()).select(*named, F.col(mark_at).alias("_at"), F.lit(0).alias("_kind"), mark.alias("_mark"), F.lit(None).cast(own.schema["_point"].dataType).alias("_point"))
    ks = [f"_k{i}" for i in range(len(keys))]
    order = [*ks, F.asc_nulls_first("_at"), "_kind", F.asc_nulls_first("_mark")]
    # Ranges are drawn from a pass of their own over the rows, which should not make these a second time.
    both = work.save(own.unionByName(told), f"{table}-told").repartitionByRange(shuffle_partitions(points.sparkSession), *order).sortWithinPartitions(*order)
    held = work.save(both.withColumn("_place", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_place", 33)), table)
    lasts = held.groupBy(*ks, "_range").agg(F.max("_mark").alias("_own"))
    before = W.partitionBy(*ks).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.withColumn("_carried", F.last("_own", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"{k}_") for k in ks], F.col("_range").alias("_range_"), "_carried")
    here = F.last("_mark", ignorenulls=True).over(W.partitionBy(*ks, "_range").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    same = F.col("_range") == F.col("_range_")
    for k in ks:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    met = held.withColumn("_here", here).where("_kind = 1").join(carried, same, "left")
    found = met.select("_point.*", F.when(F.col("_at").isNotNull(), F.coalesce("_here", "_carried")).alias("_found"))
    far = F.col(at) - F.col("_found.at")
    ok = F.lit(True) if within is None else far <= within
    return found.select(*points.columns, *[F.when(ok, F.col(f"_found.v{k}")).alias(v) for k, v in enumerate(values)], F.when(ok, far).alias(distance))
