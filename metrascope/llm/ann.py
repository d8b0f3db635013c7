"""Nearest neighbours by cosine with multi-index hashing.

Vectors become binary codes of 128 bits: signs after a learned rotation (PCA,
then iterative quantisation). A code is split into eight substrings, each with
an index. Of two codes within a Hamming radius r = 8 s + t, one of the first
t + 1 substrings differs in at most s bits, or one of the others in at most
s - 1 (pigeonhole): probing the indexes for substrings that near a query's
finds every code within r. Those candidates are ranked by the cosine of the
original vectors in double precision.

Rotation and radius come from at most ``SAMPLE`` vectors: the radius takes in
``COVER`` of the sample's own nearest neighbours, which are farther than those
among all rows. Every row is indexed. There are two ways to probe, which find
the same rows:

* A radius that takes at most ``PROBES`` keys of a substring is probed by an
  equi-join: rows are listed by (substring, key), queries by the keys that they
  probe. Substrings have 16 or 32 bits, whichever is nearer to the logarithm of
  the number of rows, so that keys of chance stay short; keys of clusters are
  dealt to several tasks. Codes travel, vectors only for what is within reach.
* A wider radius takes more keys than a join should list. Queries are then
  broadcast in blocks of bounded size; each task indexes its rows, which stay
  where they are, and probes for the block. What is shuffled is the k best of
  each task. Work is in proportion to rows times queries, as it must be where
  nothing tells neighbours from others.

Queries that find fewer than k within the radius are searched again in full.
Of equal vectors only the k + 1 smallest ids can be among anyone's k nearest,
so that a vector which a third of all rows have is held k + 1 times.

Defined results: vectors that are null, zero, of another length than most, or
with null or non-finite components take no part, nor do rows with a null id; a
row is no candidate for queries of its own id; of rows that repeat a query id
the smallest vector asks, and a vec_id that is found several times counts once,
with its best score; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..workspace import spread
from .common import Workspace, join_dealt, read

#: Vectors that a fit may use at most; share of neighbours that the radius takes in.
SAMPLE, COVER = 10_000, 0.95
#: Bits of a code and number of its substrings.
BITS, PARTS = 128, 8
#: Keys that a query probes of a substring, at most, for the equi-join.
PROBES = 200
#: Rows that a task indexes together, queries of a block, and bytes of their vectors, at most.
ROWS, QUERIES, QUERY_BYTES = 65_536, 16_384, 32 << 20

_OUT = "query_id long, vec_id long, score double"


class Codes:
    """Projection to signs, and the search radius."""

    def __init__(self, projection, radius: int):
        self.projection, self.radius = projection, radius

    def __call__(self, unit):
        """Codes of unit vectors: a row of 16-bit substrings each."""
        import numpy as np

        bits = np.packbits(unit @ self.projection > 0, axis=1)
        return np.ascontiguousarray(bits).view(">u2").astype(np.uint16)


def distances(codes, code):
    """Hamming distances of rows of substrings."""
    import numpy as np

    return np.bitwise_count(codes ^ code).sum(axis=-1, dtype=np.int64)


def reaches(radius: int, parts: int = PARTS) -> list[int]:
    """How many bits of each of so many substrings a probe may turn; -1: none has to be probed."""
    s, t = divmod(radius, parts)
    return [s if p <= t else s - 1 for p in range(parts)]


def unit_rows(x):
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(x, norms, q, q_norm):
    """Row by row, so that equal vectors have equal scores wherever they are."""
    return (x * q).sum(axis=1) / (norms * q_norm)


def fit(x, k: int = 5, cover: float = COVER, rounds: int = 30) -> Codes:
    """Codes learned from the rows of ``x``."""
    import numpy as np

    draw = np.random.default_rng(5)
    dim = x.shape[1]
    if not len(x):
        return Codes(np.zeros((dim, BITS)), BITS)
    unit = unit_rows(x)
    _, vectors = np.linalg.eigh(unit.T @ unit)
    basis = vectors[:, ::-1][:, :BITS]
    if dim < BITS:  # more bits than axes: each bit is the side of a direction, near to orthogonal to the others
        basis = basis @ np.linalg.qr(draw.standard_normal((BITS, dim)))[0].T
    reduced = unit @ basis
    turn = np.linalg.qr(draw.standard_normal((BITS, BITS)))[0]
    for _ in range(rounds):
        signs = np.where(reduced @ turn > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(reduced.T @ signs)
        turn = u @ vt
    codes = Codes(basis @ turn, BITS)
    coded = codes(unit)
    ask = draw.permutation(len(x))[:500]
    near: list = []
    for i in ask:
        score = unit @ unit[i]
        score[i] = -2
        best = np.argsort(-score)[: min(k, len(x) - 1)]
        near += distances(coded[best], coded[i]).tolist()
    if near:
        codes.radius = int(np.quantile(near, cover))
    return codes


def _masks(bits: int, within: int):
    """All ways to turn at most so many bits."""
    import numpy as np

    return np.array([sum(1 << b for b in c) for n in range(min(bits, within) + 1) for c in combinations(range(bits), n)], np.int64)


class SubstringIndex:
    """Rows by each substring of their codes."""

    def __init__(self, codes):
        import numpy as np

        self.codes = codes
        self.order, self.starts = [], []
        for p in range(PARTS):
            key = codes[:, p].astype(np.int64)
            self.order.append(np.argsort(key, kind="stable").astype(np.int32))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << 16))]))

    def within(self, code, radius: int, masks: list):
        """Places of all codes within the radius of one; ``masks`` has what is turned in each substring."""
        import numpy as np

        seen = np.zeros(len(self.codes), bool)
        for p, turned in enumerate(masks):
            keys = int(code[p]) ^ turned
            a, n = self.starts[p][keys], self.starts[p][keys + 1] - self.starts[p][keys]
            a, n = a[n > 0], n[n > 0]
            if len(n):
                seen[self.order[p][np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]] = True
        found = np.flatnonzero(seen)
        return found[distances(self.codes[found], code) <= radius]


def _scored(x, ids, q, q_id, k: int) -> tuple:
    """(ids, scores) of the k best ids, each by its best row."""
    import numpy as np

    norm = lambda v: np.sqrt((v * v).sum(axis=-1))
    score = cosines(x, norm(x), q, norm(q))
    order = np.lexsort((ids, -score))
    best = order[:k]
    if len(np.unique(ids[best])) < len(best):
        best = order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
    return ids[best].tolist(), score[best].tolist()


def _vectors(column):
    """Vectors of an Arrow column as rows, at a scale at which their squares are in range: the cosine is the same."""
    import numpy as np

    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    norm = (x * x).sum(axis=1)
    odd = ~np.isfinite(norm) | (norm < 1e-300)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
    return x


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search(codes: Codes, k: int, full: bool, sent):
    """The k best of each ``ROWS`` rows of a task for each query of a block; ``sent``: ids and vectors of these."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, n = [], 0
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            if n + batch.num_rows > ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(batch)
            n += batch.num_rows
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        q_ids, q = sent.value
        asked, masks = codes(unit_rows(q)), [_masks(16, r) for r in reaches(codes.radius)]
        for rows in gathered(batches):
            x, ids = _vectors(rows.column("v").combine_chunks()), rows.column("id").to_numpy()
            index = None if full else SubstringIndex(codes(unit_rows(x)))
            for start in range(0, len(q), 1024):
                out: list[list] = [[], [], []]
                for i in range(start, min(start + 1024, len(q))):
                    found = np.arange(len(x)) if full else index.within(asked[i], codes.radius, masks)
                    found = found[ids[found] != q_ids[i]]
                    best, score = _scored(x[found], ids[found], q[i], q_ids[i], k)
                    out[0] += [int(q_ids[i])] * len(best)
                    out[1] += best
                    out[2] += score
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return run


def _blocks(rows: DataFrame, queries: DataFrame, n_queries: int, dim: int, codes: Codes, k: int, full: bool, work: Workspace, name: str) -> DataFrame:
    """What rows find for each query, block of queries by block: vectors of rows stay where they are, a block is broadcast."""
    import numpy as np

    spark, size = rows.sparkSession, max(1, min(QUERIES, QUERY_BYTES // (8 * dim)))
    blocks, held = -(-n_queries // size), spread(rows.select("id", "v"), "id")
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == b).select("id", "v").toArrow()
        asked = _vectors(block["v"].combine_chunks()) if block.num_rows else np.zeros((0, dim))
        sent = spark.sparkContext.broadcast((block["id"].to_numpy(), asked))
        work.save(held.mapInArrow(_search(codes, k, full, sent), _OUT), f"{name}/block={b}")
        sent.unpersist()
    return spark.read.schema(_OUT).parquet(*[f"{work.path}/{name}/block={b}" for b in range(blocks)])


def join_parts(radius: int, n_rows: int) -> int | None:
    """Substrings of an equi-join: of two widths the one that is nearer to the binary logarithm of the number of rows, if a query probes few enough keys of it; None if of neither."""
    fits = [p for p in (8, 4) if max(_n_masks(BITS // p, r) for r in reaches(radius, p)) <= PROBES]
    return min(fits, key=lambda p: abs(BITS // p - max(1, n_rows).bit_length()), default=None)


def _n_masks(bits: int, within: int) -> int:
    return sum(comb(bits, n) for n in range(min(bits, within) + 1))


def _listed(codes: Codes, probe: bool, parts: int):
    """(id, v) to (id, both halves of the code, keys): (part, substring) of a row's own substrings, or of those that a query probes."""
    bits = BITS // parts
    masks = [_masks(bits, r if probe else min(r, 0)) for r in reaches(codes.radius, parts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            own = codes(unit_rows(_vectors(batch.column(1)))) if batch.num_rows else np.zeros((0, PARTS), np.uint16)
            halves, subs = own.view(np.int64), own.view(np.uint16 if parts == PARTS else np.uint32)
            keys = [np.concatenate([p << bits | (int(c[p]) ^ masks[p]) for p in range(parts)]).tolist() for c in subs]
            yield pa.record_batch([batch.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64()))], ["id", "c0", "c1", "keys"])

    return run


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, q, vec_id, v) to (query_id, vec_id, score)."""
    import numpy as np

    for batch in batches:
        if batch.num_rows:
            q, x = _vectors(batch.column(1)), _vectors(batch.column(3))
            norm = lambda v: np.sqrt((v * v).sum(axis=1))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(cosines(x, norm(x), q, norm(q)))], schema=_FOUND)


def _joined(rows: DataFrame, queries: DataFrame, codes: Codes, parts: int, work: Workspace) -> DataFrame:
    """What each query finds by an equi-join on (part, substring): only codes travel, and vectors of what is within the radius.

    A key of many rows, as clusters make it, is dealt to several tasks.
    """
    shape = "id long, c0 long, c1 long, keys array<long>"
    held, asked = (work.save(df.select("id", "v").mapInArrow(_listed(codes, probe, parts), shape), name) for df, probe, name in ((rows, False, "row-codes"), (queries, True, "query-codes")))
    by_key = lambda df, name: df.select(F.col("id").alias(name), F.explode("keys").alias("key"), F.col("c0").alias(f"{name}_0"), F.col("c1").alias(f"{name}_1"))
    apart = sum((F.bit_count(F.col(f"vec_id_{h}").bitwiseXOR(F.col(f"query_id_{h}"))) for h in (0, 1)), F.lit(0))
    probes = by_key(asked, "query_id")
    # Rows whose keys nobody asks for do not take part.
    own = work.save(by_key(held, "vec_id").join(probes.select("key").distinct(), "key", "left_semi"), "row-keys")
    met = join_dealt(own, probes, "key", F.col("vec_id")).where((F.col("vec_id") != F.col("query_id")) & (apart <= codes.radius))
    met = work.save(met.select("query_id", "vec_id").distinct(), "met")
    # A query may find any share of the rows, and so may a row be found: vectors come by dealt joins, too.
    of = lambda df, name, v: df.select(F.col("id").alias(name), F.col("v").alias(v))
    pairs = join_dealt(join_dealt(met, of(queries, "query_id", "q"), "query_id", F.col("vec_id")), of(rows, "vec_id", "v"), "vec_id", F.col("query_id"), met)
    return pairs.select("query_id", "q", "vec_id", "v").mapInArrow(_rerank, _OUT)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part, whatever their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", codes: Codes | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of ``queries``."""
    import numpy as np

    work = Workspace(vectors.sparkSession, "ann")
    told = usable(vectors, id_col, vector_col)
    sizes = told.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    asked = usable(queries, id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    asked = work.save(asked, "queries")
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    told = told.where(F.size("v") == dim).dropDuplicates(["id", "v"])
    rows = work.save(told.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "rows")
    n_rows, n_queries = rows.count(), asked.count()
    if codes is None:
        # About as many as SAMPLE by a hash of their ids, so that no task and not the driver sorts all rows.
        share = min(1.0, 0.95 * SAMPLE / max(1, n_rows))
        sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).limit(SAMPLE)
        sample = sorted(sample.collect())
        codes = fit(np.array([r["v"] for r in sample], float).reshape(len(sample), dim), k)
    if (parts := join_parts(codes.radius, n_rows)) is not None:
        found = work.save(_joined(rows, asked, codes, parts, work), "found")
    else:
        found = _blocks(rows, asked, n_queries, dim, codes, k, False, work, "found") if n_queries else asked.selectExpr("id AS query_id", "id AS vec_id", "0D AS score")
    # A vec_id that several rows have counts once.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    short = asked.join(found.groupBy("query_id").count().where(F.col("count") >= k), F.col("id") == F.col("query_id"), "left_anti")
    short = work.save(short, "short")
    n_short = short.count()
    if n_short and n_rows > 1:
        again = _blocks(rows, short, n_short, dim, codes, k, True, work, "again").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(x, ids: Sequence[int], queries: Sequence[int], k: int = 5) -> dict[int, list[int]]:
    """The true k nearest ids of each query id, for measuring recall."""
    import numpy as np

    ids, n = np.asarray(ids), np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        score = cosines(x, n, x[i], n[i])
        best = np.lexsort((ids, -score))
        out[q] = ids[best][ids[best] != q][:k].tolist()
    return out


def op2_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
