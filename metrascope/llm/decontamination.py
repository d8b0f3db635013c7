"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Each run of ``WINDOW`` consecutive words of a benchmark item is a window; an
item of fewer words is one. A window is the set of its shingles of ``SHINGLE``
words (or of all its words, if fewer), and a document contains it only if it
has them all. So of each window's shingles, in order of rarity, a prefix of one
is enough: documents and windows meet by a window's rarest shingle alone.

1. Documents count those shingles that occur in items.
2. Each window chooses its rarest, by counts of all documents.
3. Places of documents where a chosen shingle stands join the windows that
   chose it. The place tells where the window would begin: what would begin
   before the text or end after it goes, and what is left is compared word by
   word.

Whether a shingle is of interest is told to documents by a bitmap of 2^16 to
2^26 bits, about ``SPARSE`` for each shingle while that fits, so what is
broadcast has a bound for benchmarks of any size; a bit that several shingles
share only lets more through. Only places that pass it are shuffled, each with
the few words around it, never texts. A shingle of many places is dealt to
several tasks, by its count; documents with the same windows look up the items
of these once.

Defined results: null text has no words and no hits; an item without words has
no windows; repeated rows are judged each; equal windows of several items count
for all of these; an item with a null id marks words, and is neither counted
nor listed; very long texts are read in full; a document that repeats a passage
is hit at each place; ties of rarity go by the shingle's hash; extra columns
are ignored; an empty table of documents gives an empty result, an empty
benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Workspace, join_groups, read
from .words import runs, slices, word_places

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 3
#: Bits of a bitmap for each shingle, and the binary logarithms of its least and largest size.
SPARSE, LEAST_BITS, MOST_BITS = 32, 16, 26
#: A shingle with over one of so many places (and over so many) is dealt to several tasks.
_SHARE, _FEW = 1000, 1000


def _mixed(h):
    import numpy as np

    for step in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(step)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(words: list[bytes], place, at, length: int):
    """A 64-bit hash of the run of ``length`` words at each of the places ``at``; that of other lengths differs."""
    import numpy as np
    import xxhash

    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[place]
    with np.errstate(over="ignore"):
        rolled = np.full(len(at), length, np.uint64)
        for k in range(length):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + one[at + k]
        return _mixed(rolled).view(np.int64)


def item_windows(items: DataFrame, work: Workspace, window: int, shingle: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(window_id, words, length of each distinct window; its window_id, token, at; window_id, item_id)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for a, b in slices(batch.column(1)):
                words, place, first = word_places(batch.column(1)[a:b])
                for k, (start, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    said, length = [words[i] for i in place[start:end].tolist()], min(window, end - start)
                    for s in range(0, end - start - length + 1 if length else 0, 4096):
                        found = [b" ".join(said[i : i + length]).decode() for i in range(s, min(s + 4096, end - start - length + 1))]
                        owner = batch.column(0).take(pa.array(np.full(len(found), a + k)))
                        yield pa.record_batch([owner, pa.array(found, pa.string()), pa.array(np.full(len(found), length, np.int32))], ["item_id", "words", "length"])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            words, place, first = word_places(batch.column(1))
            sizes = np.minimum(np.diff(first), shingle)
            for size in np.unique(sizes).tolist():
                at, text = runs(place, first, size)
                own = sizes[text] == size
                at, text = at[own], text[own]
                yield pa.record_batch([batch.column(0).take(pa.array(text)), pa.array(shingle_hashes(words, place, at, size)), pa.array((at - first[text]).astype(np.int32))], ["window_id", "token", "at"])

    found = items.select(F.col(id_col).cast("string").alias("item_id"), text_col).mapInArrow(cut, "item_id string, words string, length int").distinct()
    found = work.save(found, "item-windows")
    distinct = work.save(found.groupBy("words", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    held = work.save(distinct.select("window_id", "words").mapInArrow(tokens, "window_id long, token long, at int"), "window-tokens")
    owners = join_groups(found, distinct, "words", "n", ["window_id"], F.col("item_id")).where("item_id IS NOT NULL").select("window_id", "item_id")
    return distinct.drop("n"), held, work.save(owners, "owners")


class Bitmap:
    """Which 64-bit numbers may be of interest, by their first bits."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, data

    def holds(self, tokens):
        import numpy as np

        slot = (tokens.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (np.frombuffer(self.data, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(tokens: DataFrame) -> Bitmap:
    """A bitmap of the distinct numbers in the column ``token``: executors combine 64 bits at a time, and at most 2^20 such come to the driver."""
    import numpy as np

    n = tokens.select("token").distinct().count()
    bits = min(MOST_BITS, max(LEAST_BITS, (n * SPARSE).bit_length()))
    slots = tokens.select(F.shiftrightunsigned("token", 64 - bits).alias("slot"))
    words = slots.selectExpr("slot DIV 64 AS k", "shiftleft(1L, CAST(slot % 64 AS INT)) AS bit").groupBy("k").agg(F.bit_or("bit").alias("bit")).toArrow()
    data = np.zeros(1 << (bits - 6), "<i8")
    data[words["k"].to_numpy()] = words["bit"].to_numpy()
    return Bitmap(bits, data.tobytes())


def _met(texts, bitmap: Bitmap, sizes: list[int]) -> Iterator[tuple]:
    """(first text, words, place, first, place and hash of each shingle that passes the bitmap, its text counted from the first) of a few texts at a time."""
    import numpy as np

    for a, b in slices(texts):
        words, place, first = word_places(texts[a:b])
        told = []
        for size in sizes:
            at, text = runs(place, first, size)
            hashes = shingle_hashes(words, place, at, size)
            held = bitmap.holds(hashes)
            told.append((at[held], hashes[held], text[held]))
        yield a, words, place, first, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*told, strict=True) if told else [[]] * 3))


def count_shingles(docs: DataFrame, bitmap: Bitmap, sizes: list[int], text_col: str) -> DataFrame:
    """(token, n): occurrences in all documents of the shingles that pass the bitmap."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for _, _, _, _, _, hashes, _ in _met(batch.column(0), sent.value, sizes):
                token, n = np.unique(hashes, return_counts=True)
                yield pa.record_batch([pa.array(token), pa.array(n.astype(np.int64))], ["token", "n"])

    return docs.select(text_col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, bitmap: Bitmap, sizes: list[int], window: int, id_col: str, text_col: str) -> DataFrame:
    """A row of each document (id, row, n_words; at is null), and of each place in it whose shingle passes the bitmap: at, token, and the words around it from the place ``begin`` on."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    schema = pa.schema([("id", to_arrow_type(kind)), ("row", pa.int64()), ("n_words", pa.int64()), ("at", pa.int64()), ("token", pa.int64()), ("begin", pa.int64()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, n_words = batch.column(0).cast(schema.field("id").type), np.zeros(batch.num_rows, np.int64)
            for a, words, place, first, at, hashes, text in _met(batch.column(1), sent.value, sizes):
                n_words[a : a + len(first) - 1] = np.diff(first)
                for k in range(0, len(at), 16384):
                    here, own = at[k : k + 16384], text[k : k + 16384]
                    low, high = np.maximum(here - window + 1, first[own]), np.minimum(here + window, first[own + 1])
                    around = [b" ".join([words[i] for i in place[x:y].tolist()]).decode() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                    start = first[own]
                    columns = [ids.take(pa.array(own + a)), row + a + own, np.diff(first)[own], here - start, hashes[k : k + 16384], low - start, pa.array(around, pa.string())]
                    yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=schema)
            none = [pa.nulls(batch.num_rows, f.type) for f in list(schema)[3:]]
            yield pa.record_batch([ids, pa.array(np.arange(row, row + batch.num_rows)), pa.array(n_words), *none], schema=schema)
            row += batch.num_rows

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, row long, n_words long, at long, token long, begin long, around string")


def rarest_shingles(held: DataFrame, seen: DataFrame, work: Workspace) -> DataFrame:
    """(window_id, token, at, n): the shingle of each window that fewest places of documents have, and their number."""
    asked = work.save(held.groupBy("token").agg(F.count(F.lit(1)).alias("windows")).join(seen, "token", "left").na.fill(0, ["n"]), "asked")
    counted = join_groups(held, asked, "token", "windows", ["n"], F.col("window_id"))
    return counted.groupBy("window_id").agg(F.min(F.struct("n", "token", "at")).alias("k")).select("window_id", "k.token", "k.at", "k.n")


def window_hits(docs: DataFrame, items: DataFrame, work: Workspace, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, row, n_words of each document; row, start, length, window_id of each occurrence of a window; window_id, item_id)."""
    windows, held, owners = item_windows(items, work, window, shingle, item_col, item_text_col)
    sizes = sorted(r[0] for r in windows.select(F.least("length", F.lit(shingle)).alias("size")).distinct().collect())  # ``shingle`` of them at most
    seen = work.save(count_shingles(docs, bitmap_of(held), sizes, text_col), "seen")
    chosen = work.save(rarest_shingles(held, seen, work), "chosen")
    told = work.save(_places(docs, bitmap_of(chosen), sizes, window, id_col, text_col), "places")

    share = max(_FEW, (chosen.agg(F.sum("n")).first()[0] or 0) / _SHARE)
    deals = F.ceil(F.greatest(F.col("n"), F.lit(1)) / F.lit(share)).cast("int")
    # Every shingle in this list has more than a share of all places, so there are fewer than _SHARE.
    frequent = chosen.withColumn("deals", deals).where("deals > 1").select("token", "deals").distinct()
    places = told.where("at IS NOT NULL").join(F.broadcast(frequent), "token", "left").withColumn("deal", F.pmod(F.xxhash64("row", "at"), F.coalesce("deals", F.lit(1))).cast("int"))
    asked = chosen.join(windows, "window_id").select("window_id", "token", F.col("at").alias("inside"), "words", "length", F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    met = places.join(asked, ["token", "deal"]).withColumn("start", F.col("at") - F.col("inside"))
    fits = (F.col("start") >= F.col("begin")) & (F.col("start") + F.col("length") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("begin") + 1).cast("int"), F.col("length")), " ") == F.col("words")
    hits = met.where(fits).where(same).select("row", "start", "length", "window_id")
    return told.where("at IS NULL").select("id", "row", "n_words"), hits, owners


def _covered() -> Column:
    """Words that an occurrence adds to those of the occurrences before it in its document."""
    before = W.partitionBy("row").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    return F.greatest(F.lit(0), end - F.greatest(F.coalesce(F.max(end).over(before), F.lit(0)), F.col("start")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``."""
    work = Workspace(docs.sparkSession, "decontamination")
    told, hits, owners = window_hits(docs, items, work, window, shingle, id_col, text_col, item_col, item_text_col)
    found = hits.withColumn("new", _covered()).groupBy("row").agg(F.sum("new").alias("n_hit"), F.sort_array(F.collect_set("window_id")).alias("windows"))
    # Documents with the same windows have the same items.
    found = work.save(found.withColumn("kind", F.sha2(F.array_join(F.col("windows").cast("array<string>"), ","), 256)), "found")
    kinds = work.save(found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows")), "kinds")
    asked = kinds.select("kind", F.explode("windows").alias("window_id"))
    listed = owners.groupBy("window_id").agg(F.sort_array(F.collect_set("item_id")).alias("items")).join(asked.groupBy("window_id").agg(F.count(F.lit(1)).alias("size")), "window_id")
    named = join_groups(asked, work.save(listed, "listed"), "window_id", "size", ["items"], F.col("kind"))
    named = named.groupBy("kind").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    named = kinds.select("kind", "n").join(named.select("kind", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "kind")
    judged = join_groups(found.select("row", "n_hit", "kind"), work.save(named, "named"), "kind", "n", ["n_items", "items_sha256"], F.col("row"))
    whole = told.join(judged.drop("kind"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return whole.select(F.col("id").alias(id_col), "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS s FROM i WHERE len(ws) > 0),
x AS (SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS x FROM p),
n AS (SELECT DISTINCT n FROM x),
q AS (SELECT k, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, n WHERE len(ws) >= n),
d AS (SELECT k, n, s, array_to_string(ws[s:s + n - 1], ' ') AS x FROM q),
h AS (SELECT k, s, d.n, item_id FROM d JOIN x ON d.n = x.n AND d.x = x.x),
c AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(s, s + n)) AS at FROM h) GROUP BY 1),
m AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN c USING (k) LEFT JOIN m USING (k)
"""
