"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, shared_dir, shuffle_partitions

__all__ = ["ASCII_SPACE", "Workspace", "identified", "join_dealt", "join_groups", "read", "shared_dir", "shuffle_partitions", "text_split"]

#: ASCII white space, the class ``[\x20\x09-\x0D]``.
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def column(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def identified(docs: DataFrame, work: Workspace, id_col: str, text_col: str, whole: bool) -> DataFrame:
    """(row, id, text) of each row of ``docs``, with a ``row`` that is made once and written; with ``whole`` (row, doc) follows as a second table.

    The original row is a struct, so that no column of its own can clash with
    those of an operator.
    """
    if whole:
        rows = work.save(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[column(c) for c in docs.columns]).alias("doc")), "rows-in")
        return rows.select("row", F.col("doc").getField(id_col).alias("id"), F.col("doc").getField(text_col).alias("text"), "doc")
    return work.save(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), "rows-in")


def text_split(column: str, parts: int, modulo: int, other: str = "") -> Column:
    """Whether crc32(id as text) leaves ``parts`` when divided by ``modulo``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(other))) % modulo == parts


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, values: Sequence[str], salt: Column, hot_groups: int = 1000, least: int = 1000) -> DataFrame:
    """Give each row the values of its group, whatever the groups' sizes; null where it has none.

    ``groups`` has one row per non-null ``key`` and, in ``size``, about how many
    rows it meets. A group with over 1/``hot_groups`` of all rows, and over
    ``least``, is copied once for each such share, and its rows are dealt to the
    copies by ``salt``. Only the keys of such groups and their numbers of copies
    are broadcast: fewer than ``hot_groups`` rows at any scale. Rows without a
    key spread, too.
    """
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    share = max(least, (total or 0) / hot_groups)
    copies = F.ceil(F.col(size) / F.lit(share)).cast("int")
    held = groups.select(F.col(key).alias("_group_key"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), copies))).alias("_group_copy"), F.struct(*values).alias("_group_values"))
    dealt, own = rows, F.lit(1)
    if (largest or 0) > share:
        listed = groups.select(F.col(key).alias("_group_hot"), copies.alias("_group_copies")).where("_group_copies > 1")
        dealt, own = rows.join(F.broadcast(listed), F.col(key) == F.col("_group_hot"), "left"), F.pmod(F.xxhash64(salt), F.coalesce("_group_copies", F.lit(1))) + 1
    dealt = dealt.withColumn("_group_deal", F.when(F.col(key).isNull(), F.xxhash64(salt)).otherwise(own))
    found = dealt.join(held, (F.col(key) == F.col("_group_key")) & (F.col("_group_deal") == F.col("_group_copy")), "left")
    return found.select(*rows.columns, *[F.col(f"_group_values.{v}").alias(v) for v in values])


def join_dealt(many: DataFrame, few: DataFrame, key: str, salt: Column, counted: DataFrame | None = None, hot_keys: int = 1000, least: int = 1000) -> DataFrame:
    """Equi-join of ``many`` with ``few`` on a key of which ``many`` may hold any share in one value.

    A key of over 1/``hot_keys`` of the rows of ``many``, and over ``least``, is
    dealt to several tasks by ``salt``, and its rows of ``few`` are copied to
    each; only such keys, fewer than ``hot_keys``, are broadcast. ``counted``:
    a written table with the same keys as ``many``, to count them by.
    """
    counts = (many if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    share = max(least, (total or 0) / hot_keys)
    if (largest or 0) <= share:
        return many.join(few, key)
    hot = counts.where(F.col("_n") > share).select(key, F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_deals"))
    dealt = many.join(F.broadcast(hot), key, "left").withColumn("_deal", F.pmod(F.xxhash64(salt), F.coalesce("_deals", F.lit(1))).cast("int")).drop("_deals")
    copies = few.join(F.broadcast(hot), key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_deals", F.lit(1)) - 1))).drop("_deals")
    return dealt.join(copies, [key, "_deal"]).drop("_deal")
