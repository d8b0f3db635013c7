"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. Sorting all
distinct blocks gives each an integer name; names of adjacent blocks are paired
and the sorted distinct pairs named again, until every text has one name. Texts
with as many blocks are equal exactly if they have the same name, so that the
identity (name, number of levels) is free of collisions: no hash decides.

Blocks are deduplicated within each task before the one shuffle that moves
text, and rows get names through narrow references. Pairs of names and groups
of copies may be of any size: both join by ``join_groups``.

Defined results: null text counts as empty; all empty texts are one group;
rows with equal texts and ids are ranked by the number of code points, then
by position, and exactly one of them stays; a null id is larger than any
other; extra columns, whatever their names, are ignored, or kept with their
values by ``drop_exact_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Workspace, identified, join_groups, shuffle_partitions

#: Bytes of a block.
BLOCK = 2048
#: Bytes of blocks a task remembers in order to send each but once.
SEEN_BYTES = 32 << 20

_CUT = "id {id}, n_chars long, text_sha256 string, row long, n_blocks int, idx int, ref long, block binary"


def _cut(block: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n_chars", pa.int64()), ("text_sha256", pa.string()), ("row", pa.int64()), ("n_blocks", pa.int32()), ("idx", pa.int32()), ("ref", pa.int64()), ("block", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        refs = held = 0
        seen: dict[bytes, int] = {}
        # A few texts at a time become Python's strings.
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            out: list[list] = [[] for _ in schema]
            size = 0
            for key, text, row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                text = text or ""
                bare = text.encode().translate(None, ASCII_SPACE)
                sha, n = hashlib.sha256(bare).hexdigest(), max(1, -(-len(bare) // block))
                for i in range(n):
                    piece = bare[i * block : (i + 1) * block]
                    ref, new = seen.get(piece), None
                    if ref is None:
                        ref, new = base + refs, piece
                        refs, held, size = refs + 1, held + len(piece) + 150, size + len(piece)
                        seen[piece] = ref
                    for column, value in zip(out, (key if not i else None, len(text), sha if not i else None, row, n, i, ref, new), strict=True):
                        column.append(value)
                if held > SEEN_BYTES:
                    seen, held = {}, 0
                if size > 8 << 20 or len(out[0]) > 50_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    out, size = [[] for _ in schema], 0
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return cut


def _name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref, key) sorted by key to (ref, name): equal keys, one name."""
    import numpy as np
    from pyspark import TaskContext

    name, before = (TaskContext.get().partitionId() << 36) - 1, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(1).to_pylist()
        new = np.fromiter((a != b for a, b in zip(keys, [before, *keys[:-1]], strict=True)), np.int64, len(keys))
        names = name + np.cumsum(new)
        name, before = int(names[-1]), keys[-1]
        yield pa.record_batch([batch.column(0), pa.array(names)], ["ref", "name"])


def _names(pairs: DataFrame, parts: int) -> DataFrame:
    """(ref, key) to (ref, name): sorted keys, dealt by key, named in order."""
    dealt = pairs.select("ref", "key").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_name_sorted, "ref long, name long")


def name_texts(docs: DataFrame, work: Workspace, block: int = BLOCK) -> DataFrame:
    """id, n_chars, text_sha256, row, identity (equal for equal texts) of each row of ``docs``: id, text, row (unique)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema["id"].dataType
    parts = shuffle_partitions(spark)
    cut = docs.select("id", "text", "row").mapInArrow(_cut(block, to_arrow_type(kind)), _CUT.format(id=kind.simpleString()))
    cut = work.save(cut, "blocks")
    names = _names(cut.where(F.col("block").isNotNull()).select("ref", F.col("block").alias("key")), parts)
    level = cut.select("row", "n_blocks", "idx", "ref").join(names, "ref").select("row", "n_blocks", "idx", "name")
    level = work.save(level, "names0")
    rows = work.save(cut.where("idx = 0").select("id", "n_chars", "text_sha256", "row", "n_blocks"), "rows")
    work.drop("blocks")

    # Each level halves the blocks of the longest text.
    levels = (max(1, rows.agg(F.max("n_blocks")).first()[0] or 1) - 1).bit_length()
    done = [level.where("n_blocks = 1").select("row", (F.col("name") * 64).alias("identity"))]
    left = level.where("n_blocks > 1")
    for depth in range(1, levels + 1):
        pairs = left.groupBy("row", "n_blocks", F.floor(F.col("idx") / 2).cast("int").alias("idx")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = work.save(pairs, f"pairs{depth}")
        # Equal pairs meet in an aggregation; sorted within its partitions, they are numbered in order.
        named = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("a", "b")
        named = work.save(named.select(F.struct("a", "b").alias("pair"), "n", F.monotonically_increasing_id().alias("name")), f"pair-names{depth}")
        # A text of a third of all rows gives a pair of as many: such pairs are dealt to several tasks.
        level = join_groups(pairs.withColumn("pair", F.struct("a", "b")), named, "pair", "n", ["name"], F.col("row"))
        level = work.save(level.select("row", F.ceil(F.col("n_blocks") / 2).cast("int").alias("n_blocks"), "idx", "name"), f"names{depth}")
        done.append(level.where("n_blocks = 1").select("row", (F.col("name") * 64 + depth).alias("identity")))
        left = level.where("n_blocks > 1")
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    return rows.drop("n_blocks").join(identity, "row")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """id_col, keep_id, group_size, kept, text_sha256 for each row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return _judged(rows, Workspace(docs.sparkSession, "exact-dedup"), block).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def _judged(rows: DataFrame, work: Workspace, block: int) -> DataFrame:
    named = work.save(name_texts(rows, work, block), "named")
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = named.groupBy("identity").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
    groups = work.save(groups.select("identity", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")
    found = join_groups(named, groups, "identity", "group_size", ["keep_id", "keep_row", "group_size"], F.col("row"))
    return found.withColumn("kept", F.col("row") == F.col("keep_row"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    work = Workspace(docs.sparkSession, "exact-dedup")
    rows = identified(docs, work, id_col, text_col, True)
    kept = _judged(rows.select("id", "text", "row"), work, BLOCK).where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS k FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size, k = 1 AS kept, sha256(bare) AS text_sha256
FROM r WINDOW w AS (PARTITION BY bare ORDER BY k)
"""
