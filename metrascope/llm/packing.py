"""Bulk-synchronous best-fit packing of tokenised documents into fixed-length sequences.

Documents over the capacity are cut into full pieces, the first being the rest.
Pieces are packed in rounds, from the longest to the shortest; a round takes
the pieces of a range of lengths and the gaps of sequences that hold the
shortest of them:

1. Pieces and gaps are sorted together, by descending size, over ranges of
   ``RANGE`` rows. Each task sweeps its range: a piece takes its successor, the
   smallest gap that holds it. What is left of the gap takes part again, in the
   same sweep as long as it is in the range.
2. Left over are, of each range, pieces without a gap before gaps without a
   piece (and gaps smaller than the range, which wait). Ranges are matched by the numbers of these, again smallest gap first;
   by rank within their range, piece meets gap in a join.
3. Pieces that no gap holds are sorted and swept once more, opening sequences.
4. The gaps that are left are written for the next round.

A round of one range is best-fit decreasing as one after the other would do it.
In other rounds, a piece may miss a smaller gap that lies in another range.
The ranges of lengths end at capacity / k for k up to 8, then halve, so that no
two pieces of a round fit where one left its gap; those with few pieces are
joined. With 2,048 tokens there are 16 rounds at most, however many documents.

A round has as many ranges as its rows fill, so a task sweeps about ``RANGE``
rows whatever the input, and gives them away a few thousand at a time. The
driver learns the number of pieces by length (at most ``capacity`` rows) and of
what is left by range (a row of three numbers for each: 61,000 for 10^9 rows).
Pieces and gaps stay on the executors.

Ids are those of the ``tokenizers`` library by default: a control string in a
text is its own token.

Defined results: null text counts as empty and is one token, the end mark;
repeated rows and null ids are packed like any others; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

CAPACITY, END_ID = 2048, 0

#: Rows of a range, about.
RANGE = 1 << 14
#: Rows that a task gives away at a time.
_TOGETHER = 4096

_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, pid long"


def _tokenize(path: str, capacity: int, end_id: int, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("pid", pa.int64())])
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokens import library_encoder

        encoder, pid = library_encoder(path, added=True), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1)), strict=True):
                ids += end
                n, start = len(ids) // 4, 0
                first = n % capacity or capacity
                for k in range(-(-n // capacity)):
                    length = capacity if k else first
                    for column, value in zip(out, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), pid), strict=True):
                        column.append(value)
                    pid += 1
                    start += length
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return pieces


#: Kinds of rows: a placed piece (size: its length, at: sequence), a piece, a gap (id: sequence), a gap smaller than all of its range.
_PLACED, _PIECE, _GAP, _SMALL = 0, 1, 2, 3
_SWEPT = "kind int, id long, size int, at long, offset int, part int, rank int"


def sweep(rows: Iterator[tuple[int, int, int]], capacity: int, new: Iterator[int] | None = None) -> tuple[list[tuple], list[tuple], list[tuple], list[tuple]]:
    """(placed, left pieces, left gaps, gaps smaller than all rows) of (kind, id, size) rows by descending size, gaps before pieces of their size.

    ``new`` gives sequences to open for pieces that no gap holds.
    """
    stack: list[tuple[int, int]] = []  # gaps that hold the piece at hand, the smallest on top
    later: list[tuple[int, int]] = []  # heap of smaller gaps
    placed, left = [], []

    def take(below: int) -> None:
        """Puts on the stack, in order, the gaps of at least a size."""
        while later and -later[0][0] >= below:
            size, sequence = heapq.heappop(later)
            stack.append((-size, sequence))

    for kind, key, size in rows:
        take(size)
        if kind == _GAP:
            stack.append((size, key))
            continue
        if stack:
            gap, sequence = stack.pop()
        elif new is not None:
            gap, sequence = capacity, next(new)
        else:
            left.append((key, size))
            continue
        placed.append((key, size, sequence, capacity - gap))
        if gap - size >= size:
            stack.append((gap - size, sequence))
        elif gap > size:
            heapq.heappush(later, (size - gap, sequence))
    return placed, left, [(sequence, gap) for gap, sequence in reversed(stack)], [(sequence, -gap) for gap, sequence in later]


def _sweeps(capacity: int, opened: int | None):
    """Sweeps a task's rows (kind, id, size); ``opened`` tells new sequences of this round from others, None opens none."""
    from itertools import chain, count, islice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        new = None if opened is None else count((opened << 24 | part) << 32)
        placed, left, gaps, small = sweep((row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True)), capacity, new)
        told = chain(
            ((_PLACED, key, size, at, offset, part, 0) for key, size, at, offset in placed),
            ((_PIECE, key, size, None, None, part, k) for k, (key, size) in enumerate(left)),
            ((_GAP, key, size, None, None, part, k) for k, (key, size) in enumerate(gaps)),
            ((_SMALL, key, size, None, None, part, 0) for key, size in small),
        )
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in _SWEPT.split(", ")]
        while rows := list(islice(told, _TOGETHER)):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def length_ranges(counts: Mapping[int, int], capacity: int, most: int) -> list[tuple[int, int, int]]:
    """(low, high, number of pieces) with low < length <= high of each round, the longest first."""
    ends = [capacity // k for k in range(1, 9)]
    while ends[-1]:
        ends.append(ends[-1] // 2)
    out: list[tuple[int, int, int]] = []
    for high, low in zip(ends[:-1], ends[1:], strict=True):
        n = sum(c for length, c in counts.items() if low < length <= high)
        if n and out and out[-1][2] + n <= most:
            out[-1] = out[-1][0], out[-1][1], out[-1][2] + n
        elif n:
            out.append((low, high, n))
        if out:
            out[-1] = low, out[-1][1], out[-1][2]
    return out


def match_ranges(left: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(range of pieces, first rank, range of gaps, first rank, number) of matches between ranges.

    ``left``: (range, pieces, gaps) by descending size; the pieces of a range
    come before its gaps, and gaps of a later range are smaller.
    """
    stack: list[list[int]] = []  # range, first rank, number of its gaps that are free; the smallest on top
    out = []
    for part, pieces, gaps in left:
        rank = 0
        while rank < pieces and stack:
            top = stack[-1]
            n = min(pieces - rank, top[2])
            out.append((part, rank, top[0], top[1], n))
            rank += n
            top[1], top[2] = top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps])
    return out


def _round(pieces: DataFrame, gaps: DataFrame, n: int, capacity: int, number: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(placed, gaps) of the rows of a round: pieces (id, size), of which there are about ``n`` with the gaps."""
    spark = pieces.sparkSession
    own = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "size")
    rows = own(pieces, _PIECE).unionByName(own(gaps, _GAP))
    ranges = max(1, -(-n // RANGE))
    order = [F.desc("size"), F.desc("kind"), F.col("id")]

    def swept(rows: DataFrame, ranges: int, opened: int | None, name: str) -> DataFrame:
        dealt = rows.repartition(1) if ranges == 1 else rows.repartitionByRange(ranges, *order)
        return work.save(dealt.sortWithinPartitions(*order).mapInArrow(_sweeps(capacity, opened), _SWEPT), f"{name}{number}")

    placed_of = lambda df: df.where(f"kind = {_PLACED}").select("id", "size", "at", "offset")
    gaps_of = lambda df, *kinds: df.where(F.col("kind").isin(*kinds)).select("id", "size")
    if ranges == 1:
        told = swept(rows, 1, number, "swept")
        return placed_of(told), gaps_of(told, _GAP, _SMALL)

    told = swept(rows, ranges, None, "swept")
    left = told.where(F.col("kind").isin(_PIECE, _GAP)).groupBy("part").pivot("kind", [_PIECE, _GAP]).count().na.fill(0).orderBy("part").collect()
    met = match_ranges([tuple(r) for r in left])
    met = [(*m, k) for k, m in enumerate(met)]
    names = ("piece_part", "piece_from", "gap_part", "gap_from", "n", "match")
    matches = F.broadcast(spark.createDataFrame(pa.table({name: pa.array([m[i] for m in met], pa.int32()) for i, name in enumerate(names)})))

    def side(kind: int, name: str) -> DataFrame:
        """id, size, match and rank in it (null if none) of the pieces or gaps that are left."""
        rows = told.where(f"kind = {kind}").select("id", "size", "part", "rank")
        inside = (F.col("part") == F.col(f"{name}_part")) & F.col("rank").between(F.col(f"{name}_from"), F.col(f"{name}_from") + F.col("n") - 1)
        return rows.join(matches, inside, "left").select("id", "size", "match", (F.col("rank") - F.col(f"{name}_from")).alias("rank"))

    pairs = side(_PIECE, "piece").where("match IS NOT NULL").join(side(_GAP, "gap").where("match IS NOT NULL").withColumnsRenamed({"id": "at", "size": "gap"}), ["match", "rank"])
    pairs = work.save(pairs.select("id", "size", "at", "gap"), f"matched{number}")
    opening = swept(own(side(_PIECE, "piece").where("match IS NULL"), _PIECE), ranges, number, "opened")
    placed = placed_of(told).unionByName(placed_of(opening)).unionByName(pairs.select("id", "size", "at", (F.lit(capacity) - F.col("gap")).alias("offset")))
    rest = pairs.where("gap > size").select(F.col("at").alias("id"), (F.col("gap") - F.col("size")).alias("size"))
    free = side(_GAP, "gap").where("match IS NULL").select("id", "size").unionByName(gaps_of(told, _SMALL))
    return placed, free.unionByName(rest).unionByName(gaps_of(opening, _GAP, _SMALL))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    work = Workspace(docs.sparkSession, "packing")
    told = docs.select(id_col, text_col).mapInArrow(_tokenize(tokenizer, capacity, end_id, to_arrow_type(kind)), _PIECES.format(id=kind.simpleString()))
    pieces = work.save(told, "pieces")
    counts = dict(pieces.groupBy("length").count().limit(capacity).collect())

    units = pieces.select(F.col("pid").alias("id"), F.col("length").cast("int").alias("size"))
    gaps = units.where("false")
    placed = []
    for number, (low, high, n) in enumerate(length_ranges(counts, capacity, RANGE)):
        fits = f"size > {low}"
        n_gaps = gaps.where(fits).count()
        done, left = _round(units.where(f"size > {low} AND size <= {high}"), gaps.where(fits), n + n_gaps, capacity, number, work)
        placed.append(done)
        gaps = work.save(gaps.where(f"NOT ({fits})").unionByName(left), f"gaps{number}")
    found = placed[0] if placed else units.selectExpr("id", "size", "id AS at", "size AS offset")
    for more in placed[1:]:
        found = found.unionByName(more)
    found = found.select(F.col("id").alias("pid"), F.col("at").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
    return pieces.join(found, "pid").select(F.col("doc_id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
