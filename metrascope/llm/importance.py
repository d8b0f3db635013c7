"""Importance resampling of documents towards a target distribution.

Features are runs of one and of two words, hashed into buckets. A first pass
over documents and targets counts them: each task sums its ``np.bincount`` into
one vector, and ``treeReduce`` merges the vectors. The second pass gathers the
logarithmic gain of each bucket, broadcast as a vector, and sums it document by
document. A Gumbel number for each id, from a hash, makes the highest scores a
sample without replacement; rows are ranked over sorted ranges, so neither the
driver nor a task sees them all.

Broadcasts and what reaches the driver have the size of a vector of ``BUCKETS``
numbers at any scale. Texts are never shuffled.

Defined results: null text has no words; a text without words has no features
and weight 0; very long texts count in full; a null id hashes as '' and comes
after all others among ties; repeated rows are scored alike and each is drawn
for itself; extra columns are ignored; without targets gains follow from zero
counts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import Workspace, read
from .words import runs, slices, word_places

#: Buckets of features; words of a document that takes part in the draw; percent of these that are drawn; seed of the draw.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Runs of two words that are hashed at a time.
_PLACES = 1 << 18


def features(texts, buckets: int) -> Iterator[tuple]:
    """(first text, number of texts, words of each, bucket of each feature, its text counted from the first) of a few texts of an Arrow array at a time."""
    import numpy as np

    for a, b in slices(texts):
        words, place, first = word_places(texts[a:b])
        single = np.fromiter(map(crc32, words), np.uint32, len(words))
        # The checksum of two words goes on from that of the first and the space.
        begun = [crc32(b" ", c) for c in single.tolist()]
        at, text = runs(place, first, 2)
        double = np.empty(len(at), np.uint32)
        for k in range(0, len(at), _PLACES):
            here = at[k : k + _PLACES]
            second, start = place[here + 1].tolist(), place[here].tolist()
            double[k : k + _PLACES] = np.fromiter(map(crc32, map(words.__getitem__, second), map(begun.__getitem__, start)), np.uint32, len(here))
        n = np.diff(first)
        yield a, b - a, n, np.concatenate([single[place], double]) % buckets, np.concatenate([np.repeat(np.arange(b - a), n), text])


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS):
    """How often each bucket occurs in all texts."""
    import numpy as np

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, bucket, _ in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = docs.select(text_col).mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    # With three levels, even a million tasks leave a hundred vectors for the driver.
    return vectors.treeReduce(np.add, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains_of(counts, wanted):
    """The gain of each bucket, in thousandths: how much likelier targets hold it, with one added to each count."""
    import numpy as np

    size, total, aim = len(counts), float(counts.sum()), float(wanted.sum())
    ratio = lambda s, t: (t + 1.0) * (total + size) / ((s + 1.0) * (aim + size))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(counts, wanted, strict=True)], np.int64)


def weigh(docs: DataFrame, gains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, row (unique), n_words, n_features, weight (floored mean gain) of each row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type, sent = to_arrow_type(kind), docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        gains, row = sent.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for first, size, n, bucket, text in features(batch.column(1), len(gains)):
                held = np.bincount(text, minlength=size)
                gained = np.bincount(text, gains[bucket], size).astype(np.int64)
                out[:, first : first + size] = n, held, gained // np.maximum(held, 1)
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.record_batch([batch.column(0).cast(id_type), rows, *map(pa.array, out)], ["id", "row", "n_words", "n_features", "weight"])

    told = docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, row long, n_words long, n_features long, weight long")
    return told.withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """id_col, n_features, weight, score, rank of each row of ``docs``; rank is null where it is not drawn."""
    work = Workspace(docs.sparkSession, "importance")
    gains = gains_of(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    told = work.save(weigh(docs, gains, id_col, text_col), "weights")
    # The first 32 bits of the digest, as the middle of an interval of (0, 1).
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    uniform = (F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    told = told.withColumn("score", F.col("weight") + F.floor(-1000.0 * F.ln(-F.ln(uniform))))
    fits = F.col("n_words") >= least_words
    drawn = told.where(fits).count() * percent // 100
    ranked = numbered(told.where(fits), [F.desc("score"), F.asc_nulls_last(id_col), F.col("row")], work, "ranked", number="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    whole = ranked.unionByName(told.where(~fits).withColumn("rank", F.lit(None).cast("long")))
    return whole.select(id_col, "n_features", "weight", "score", "rank")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: The checksum of each distinct feature is computed byte by byte from a table of 256 entries.
OP13_SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS tab),
w AS (SELECT 0 AS side, row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
      UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT side, k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS x FROM w),
c AS (SELECT side, k, x, count(*) AS n FROM f GROUP BY 1, 2, 3),
x AS (SELECT x, xor(4294967295, list_reduce(list_transform(range(strlen(x)), lambda i: ('0x' || substr(hex(encode(x)), 2 * i + 1, 2))::BIGINT), lambda h, b: xor(h >> 8, tab[(xor(h, b) & 255) + 1]), 4294967295::BIGINT)) % 10000 AS b
      FROM (SELECT DISTINCT x FROM c), bits),
v AS (SELECT b, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM c JOIN x USING (x) GROUP BY 1),
total AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM v),
gain AS (SELECT b, floor(1000 * ln((coalesce(v.t, 0) + 1)::DOUBLE * (total.s + 10000) / ((coalesce(v.s, 0) + 1)::DOUBLE * (total.t + 10000))))::BIGINT AS g FROM v, total),
d AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM c JOIN x USING (x) JOIN gain USING (b) WHERE side = 0 GROUP BY 1),
s AS (SELECT w.k, doc_id, len(ws) >= 20 AS fits, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM w LEFT JOIN d ON d.k = w.k WHERE side = 0),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE fits)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM s LEFT JOIN r USING (k)
"""
