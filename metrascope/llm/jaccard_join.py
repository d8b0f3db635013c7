"""Similarity join of word-shingle sets by Jaccard, with signature trees.

Documents are sets of 64-bit hashes of 5-word shingles; two are linked if
their Jaccard similarity is at least ``PERCENT`` / 100. The join loses no link:

1. Equal sets are one node from the start, so copies are never compared.
2. Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each
   in any one order of all shingles; nodes meet in a bucket per such shingle.
   The order is that of hashes, with up to ``COMMON`` frequent shingles last, so
   that passages which many documents share open hardly any bucket. Shingles
   that nevertheless fill a bucket of over ``HOT`` nodes go behind all rarer
   ones, too: they are counted by shuffle and kept as a table, any number of
   them, and only the sets that meet them get another prefix (``_behind``).
3. In each bucket, the first node is compared with all others. What passes the
   exact comparison makes components: large groups of near copies are connected
   by as many comparisons as they have members.
4. Buckets that hold several components get a signature tree: its nodes hold
   bitmaps of shingles combined by OR, ranges of set sizes, and the component
   if there is but one. A dual traversal drops pairs of tree nodes of one
   component, and those whose largest possible overlap is too small. What is
   left is compared exactly, and the components are joined anew.

Buckets over ``BUCKET`` nodes are cut into pieces that meet pairwise, except
pieces of their largest component, which need not meet each other. Frequent
shingles, whose buckets may hold any share of all nodes, form theirs by
aggregation; wherever rows meet a pivot, a bucket or a label, ``join_groups``
deals those of large groups to several tasks.

Shingles are hashed to 64 bits. A set's name is 63 bits of a hash; a second
hash of 63 bits tells sets of one name apart, and these get other names.

Defined results: null text counts as empty; texts without words have no
shingles and no links; rows with equal texts are copies whatever their ids; a
component's id is its smallest non-null document id; extra columns, whatever
their names, are ignored, or kept with their values by
``drop_near_duplicates``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, identified, join_groups, shuffle_partitions

#: Words of a shingle, and the least Jaccard similarity of a link in percent.
WORDS, PERCENT = 5, 80
#: Frequent shingles that the order puts last, at most; documents of a task that make one a candidate.
COMMON, LOCAL = 1 << 16, 4
#: Nodes of a bucket beyond which its shingle goes behind rarer ones.
HOT = 8192
#: Nodes of a bucket that one task holds; buckets that a node is marked with, so that pairs are found once.
BUCKET, MARKS = 2048, 16
#: Bits of a bitmap at most, so that a piece of a bucket has a bounded size whatever its texts.
BITS = 1 << 16
#: Bytes of text handled at a time; rows under a node of the lowest level of a tree.
_SLICE, _LEAF = 8 << 20, 32


def least_overlap(n):
    """Shingles that a set of n has to share with any set it is linked to."""
    return (n * PERCENT + 99) // 100


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts) -> Iterator:
    """The sorted array of distinct shingle hashes of each string of an Arrow array."""
    import numpy as np
    import pyarrow.compute as pc

    if texts.offset:  # Arrow's lower-casing misreads slices that are cast afterwards
        texts = texts.take(pa.array(np.arange(len(texts))))
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
        yield from _slice_sets(texts[at:to])
        at = to


def _slice_sets(texts) -> Iterator:
    import numpy as np
    import pyarrow.compute as pc
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().dictionary_encode()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    index = words.indices.to_numpy()
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    full = pc.binary_length(split.flatten()).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate([[0], np.cumsum(full)])
    h, offsets = hashed[index[full]], upto[offsets]
    p = np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            rolled = rolled * p + h[k : k + len(rolled)]
        rolled = _mix(rolled)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            else:
                short = np.uint64(0)
                for x in h[a:b]:
                    short = short * p + x
                yield _mix(np.array([short + np.uint64(b - a)]))[: int(b > a)]


def node_of(shingles, clashes: frozenset[int] = frozenset()) -> int:
    """The name of a set: 63 bits of a hash of its sorted shingles, or of another hash if several sets have the first."""
    name = _digest(shingles, 7)
    return _digest(shingles, 8) if name in clashes else name


def _digest(shingles, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=seed) >> 1


def bitmap(shingles):
    """One bit for each shingle in a power of two, four times the set's size at least, but ``BITS`` at most.

    The fewer shingles share a bit, the closer the overlap of bitmaps is to that of sets.
    """
    import numpy as np

    m = min(BITS, max(64, 1 << int(4 * len(shingles) - 1).bit_length()))
    bits = np.zeros(m, np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(m - 1)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


_SETS = "doc_id {id}, row long, n long, node long, proof long, token long, seen long"


def _describe(id_type: pa.DataType):
    """Rows of documents (doc_id, row, n, node, second hash), and of a task's frequent shingles (token, seen)."""
    schema = pa.schema([("doc_id", id_type), *[(c, pa.int64()) for c in ("row", "n", "node", "proof", "token", "seen")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        met: set[int] = set()
        pending, size = [], 0

        def count(pending: list, tokens, counts):
            new, n = np.unique(np.concatenate(pending), return_counts=True)
            all_, back = np.unique(np.concatenate([tokens, new[n > 1]]), return_inverse=True)
            total = np.bincount(back, np.concatenate([counts, n[n > 1]]), len(all_)).astype(np.int64)
            top = np.argsort(-total, kind="stable")[:COMMON]
            return all_[top], total[top]

        for batch in batches:
            n, nodes, proofs = [], [], []
            for shingles in shingle_sets(batch.column(1)):
                n.append(len(shingles))
                nodes.append(node_of(shingles) if len(shingles) else None)
                proofs.append(_digest(shingles, 8) if len(shingles) else None)
                if len(shingles) and nodes[-1] not in met:
                    met.add(nodes[-1])
                    pending.append(shingles)
                    size += len(shingles)
                    if size > 2_000_000:
                        tokens, counts = count(pending, tokens, counts)
                        pending, size = [], 0
            if len(met) > 1_000_000:
                met.clear()
            none = pa.nulls(len(n), pa.int64())
            yield pa.record_batch([batch.column(0).cast(id_type), batch.column(2), *[pa.array(c, pa.int64()) for c in (n, nodes, proofs)], none, none], schema=schema)
        if pending:
            tokens, counts = count(pending, tokens, counts)
        tokens, counts = tokens[counts >= LOCAL], counts[counts >= LOCAL]
        yield pa.record_batch([pa.nulls(len(tokens), id_type), *[pa.nulls(len(tokens), pa.int64())] * 4, pa.array(tokens.view(np.int64)), pa.array(counts)], schema=schema)

    return run


def _prefixes(common, clashes: frozenset[int]):
    """(node, n, bits, prefix, frequent part of the prefix) of each set that is new to its task, from (text) or (text, its shingles of large buckets)."""
    import numpy as np

    common = np.sort(np.array(common, np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            behind = batch.column(1) if batch.num_columns > 1 else [None] * batch.num_rows
            for s, often in zip(shingle_sets(batch.column(0)), behind, strict=True):
                node = node_of(s, clashes)
                if not len(s) or node in met:
                    continue
                met.add(node)
                p = len(s) - least_overlap(len(s)) + 1
                last = np.zeros(len(s), bool)
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                later = s[last]
                if often is not None:  # rare, then those of large buckets, then the most frequent
                    large = np.isin(s, often.values.to_numpy().view(np.uint64)) & ~last
                    last, later = last | large, np.concatenate([s[large], later])
                rare = s[~last][:p]
                for column, value in zip(out, (node, len(s), bitmap(s).tobytes(), rare.tobytes(), later[: p - len(rare)].tobytes()), strict=True):
                    column.append(value)
            if len(met) > 1_000_000:
                met.clear()
            yield pa.record_batch([*[pa.array(c, pa.int64()) for c in out[:2]], *[pa.array(c, pa.binary()) for c in out[2:]]], ["node", "n", "bits", "prefix", "shared"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, prefix) to (key, node)."""
    import numpy as np

    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            blobs = part.column(1).to_pylist()
            nodes = np.repeat(part.column(0).to_numpy(), [len(b) // 8 for b in blobs])
            yield pa.record_batch([pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(nodes)], ["key", "node"])


def _all_shingles(common):
    """(node, text) to (key, node) of all shingles but the most frequent."""
    import numpy as np

    common = np.sort(np.array(common, np.int64).view(np.uint64))

    def told(sets: list, nodes: list) -> pa.RecordBatch:
        keys = np.concatenate(sets)
        rare = ~np.isin(keys, common)
        return pa.record_batch([pa.array(keys[rare].view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), [len(s) for s in sets])[rare])], ["key", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, nodes, size = [], [], 0
        for batch in batches:
            for node, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1)), strict=True):
                sets.append(s)
                nodes.append(node)
                size += len(s)
                if size > 500_000:
                    yield told(sets, nodes)
                    sets, nodes, size = [], [], 0
        if sets:
            yield told(sets, nodes)

    return run


def _buckets(limit: int | None):
    """(key, node) in order to (bucket, pivot, node) of keys with several nodes; to (null, key, node) of those with over ``limit``.

    A bucket's name comes from its nodes, so that shingles of the same nodes
    give one bucket; names that meet by chance only make a bucket larger.
    """
    return lambda batches: _named(batches, limit)


def _named(batches: Iterator[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    import numpy as np

    def large(key, nodes):
        return pa.record_batch([pa.nulls(len(nodes), pa.int64()), pa.array(np.full(len(nodes), key, np.int64)), pa.array(nodes)], ["bucket", "pivot", "node"])

    def told(keys, nodes):
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[new], nodes[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        with np.errstate(over="ignore"):
            names = np.add.reduceat(_mix(nodes.view(np.uint64)), starts) + sizes.astype(np.uint64)
        several = sizes > 1
        if limit is not None:
            for k in np.flatnonzero(sizes > limit).tolist():
                yield large(keys[starts[k]], nodes[starts[k] : starts[k] + sizes[k]])
            several &= sizes <= limit
        _, first = np.unique(names[several], return_index=True)
        starts, sizes, names = starts[several][first], sizes[several][first], names[several][first]
        places = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        yield pa.record_batch([pa.array(np.repeat(names.view(np.int64), sizes)), pa.array(np.repeat(nodes[starts], sizes)), pa.array(nodes[places])], ["bucket", "pivot", "node"])

    held: list = []
    size = 0
    long_key = long_pivot = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if long_key is not None:  # a bucket too large to hold goes on
            n = int(np.searchsorted(keys != long_key, True)) if (keys != long_key).any() else len(keys)
            if n:
                yield large(long_key, nodes[:n]) if limit is not None else pa.record_batch([pa.array(np.full(n, long_key)), pa.array(np.full(n, long_pivot)), pa.array(nodes[:n])], ["bucket", "pivot", "node"])
            keys, nodes = keys[n:], nodes[n:]
            if not len(keys):
                continue
            long_key = None
        if held:
            keys, nodes = np.concatenate([held[0], keys]), np.concatenate([held[1], nodes])
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield from told(keys[:cut], nodes[:cut])
        held, size = [keys[cut:], nodes[cut:]], len(keys) - cut
        if size > 1_000_000:
            long_key, long_pivot = keys[-1], held[1][0]
            yield large(long_key, held[1]) if limit is not None else pa.record_batch([pa.array(held[0]), pa.array(np.full(size, long_pivot)), pa.array(held[1])], ["bucket", "pivot", "node"])
            held = []
    if held:
        yield from told(*held)


def _fold(bits, words: int):
    """Bitmaps of the set modulo a smaller power of two."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


class _Level:
    """Bitmaps, least and largest size, most shingles beyond bits, and component (-1: several) of tree nodes."""

    def __init__(self, bits, low, high, extra, component):
        self.bits, self.low, self.high, self.extra, self.component = bits, low, high, extra, component

    def up(self) -> _Level:
        import numpy as np

        at = np.arange(0, len(self.low), _LEAF)
        one = np.minimum.reduceat(self.component, at)
        one[one != np.maximum.reduceat(self.component, at)] = -1
        return _Level(np.bitwise_or.reduceat(self.bits, at), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.extra, at), one)


def signature_tree(n, bits, component) -> list[_Level]:
    """Levels from the rows up to one node; rows should be sorted so that like stands by like."""
    import numpy as np

    levels = [_Level(bits, n, n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), component)]
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].up())
    return levels


def _possible(a: _Level, i, b: _Level, j):
    """For places i of a and j of b: whether some pair below may be linked and joins two components."""
    import numpy as np

    both = np.bitwise_count(a.bits[i] & b.bits[j]).sum(axis=1, dtype=np.int64)
    # A set's shingles on given bits are no more than these bits and its shingles beyond bits.
    most = np.minimum(both + np.minimum(a.extra[i], b.extra[j]), np.minimum(a.high[i], b.high[j]))
    sizes = (a.high[i] * 100 >= b.low[j] * PERCENT) & (b.high[j] * 100 >= a.low[i] * PERCENT)
    apart = (a.component[i] < 0) | (a.component[i] != b.component[j])
    return sizes & apart & (most * (100 + PERCENT) >= PERCENT * (a.low[i] + b.low[j]))


def dual_traversal(a: list[_Level], b: list[_Level], same: bool) -> Iterator[tuple]:
    """Places (i, j) of rows of two trees that may be linked; i < j if both are one tree."""
    import numpy as np

    top = max(len(a), len(b)) - 1
    at = lambda t, k: t[min(k, len(t) - 1)]
    todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        level, i, j = todo.pop()
        ok = _possible(at(a, level), i, at(b, level), j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        for s in range(0, len(i), 256):  # children of so many pairs at a time
            ci, cj = _children(a, level, i[s : s + 256]), _children(b, level, j[s : s + 256])
            for x, y in zip(ci, cj, strict=True):
                gi, gj = np.repeat(x, len(y)), np.tile(y, len(x))
                if same:
                    keep = gi < gj if level == 1 else gi <= gj
                    gi, gj = gi[keep], gj[keep]
                if len(gi):
                    todo.append((level - 1, gi, gj))


def _children(tree: list[_Level], level: int, places) -> list:
    import numpy as np

    if level >= len(tree):
        return [np.array([p]) for p in places]
    n = len(tree[level - 1].low)
    return [np.arange(p * _LEAF, min(n, (p + 1) * _LEAF)) for p in places]


def _candidates(nodes, n, blobs, component) -> Iterator[tuple]:
    """Places (i, j) of rows that may be linked across components in one piece of a bucket.

    Linked sets have sizes within a factor of two, and so bitmaps of the same
    or of neighbouring widths; the wider ones are folded to meet the others.
    """
    import numpy as np

    words = np.array([len(x) // 8 for x in blobs])
    trees: dict = {}
    for w in np.unique(words).tolist():
        own = np.flatnonzero(words == w)
        own = own[np.lexsort((nodes[own], component[own]))]
        bits = np.frombuffer(b"".join(blobs[i] for i in own.tolist()), np.uint64).reshape(len(own), w)
        trees[w] = own, signature_tree(n[own], bits, component[own])
        if w // 2 in trees:
            half = signature_tree(n[own], _fold(bits, w // 2), component[own])
            low, small = trees[w // 2]
            for i, j in dual_traversal(small, half, False):
                yield low[i], own[j]
        for i, j in dual_traversal(trees[w][1], trees[w][1], True):
            yield own[i], own[j]


_PAIRS = "a long, b long"
_PIECE = ("piece", "node", "n", "bits", "component", "bucket", "i", "j", "own", "marks")


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PIECE`` in order of pieces to pairs of nodes.

    Two nodes that meet in several pieces of a bucket count in the one that
    their chunks name, and of several buckets in the first that both have among
    their ``marks``.
    """
    import numpy as np

    held: list[tuple] = []

    def close() -> pa.RecordBatch | None:
        nodes, n, component, own = (np.array([r[k] for r in held], np.int64) for k in (1, 2, 4, 8))
        bucket, low, high = held[0][5], held[0][6], held[0][7]
        marks = np.array([(r[9] + [None] * MARKS)[:MARKS] for r in held], object)
        empty = np.equal(marks, None)
        marks = np.where(empty, 0, marks).astype(np.int64)
        out: list = []
        for i, j in _candidates(nodes, n, [r[3] for r in held], component):
            here = (np.minimum(own[i], own[j]) == low) & (np.maximum(own[i], own[j]) == high)
            i, j = i[here], j[here]
            for s in range(0, len(i), 4096):
                x, y = i[s : s + 4096], j[s : s + 4096]
                shared = ((marks[x][:, :, None] == marks[y][:, None, :]) & ~empty[x][:, :, None] & ~empty[y][:, None, :]).any(axis=2)
                first = np.where(shared, marks[x], np.iinfo(np.int64).max).min(axis=1)
                ours = ~shared.any(axis=1) | (first == bucket)
                out.append((nodes[x[ours]], nodes[y[ours]]))
        if not out:
            return None
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[0] != held[0][0]:
                if (out := close()) is not None:
                    yield out
                held = []
            held.append(row)
    if held and (out := close()) is not None:
        yield out


def _may_link(n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> bool:
    """Whether the bitmaps of two sets allow a link."""
    import numpy as np

    one, two = (np.frombuffer(v, np.uint64)[None] for v in (bits_a, bits_b))
    w, zero = min(one.shape[1], two.shape[1]), np.zeros(1, np.int64)
    trees = [signature_tree(np.array([m]), _fold(v, w), np.array([c])) for m, v, c in ((n_a, one, 0), (n_b, two, 1))]
    return bool(_possible(trees[0][0], zero, trees[1][0], zero)[0])


def _meetings(met: Callable):
    """Rows (hub, deal, node, values...) in order, the hub's own first, to the pairs (a, b) of hub and others for which ``met`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            out: list[list] = [[], []]
            hubs, deals, nodes, *values = (c.to_pylist() for c in batch.columns)
            for hub, deal, node, *told in zip(hubs, deals, nodes, *values, strict=True):
                if node == hub:
                    at, own = (hub, deal), told
                elif at == (hub, deal) and met(own, told):
                    out[0].append(hub)
                    out[1].append(node)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return run


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, calls, text) to rows (hub, deal, node, shingles): a set for each of the hubs that it has to meet."""
    import pyarrow.compute as pc

    for whole in batches:
        for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(2))], pa.binary())
            place, calls = pc.list_parent_indices(batch.column(1)), batch.column(1).flatten()
            for i in range(0, len(place), 4096):
                here = place[i : i + 4096]
                yield pa.record_batch([calls.field("hub")[i : i + 4096], calls.field("deal")[i : i + 4096], batch.column(0).take(here), sets.take(here)], ["hub", "deal", "node", "shingles"])


def linked(x, y) -> bool:
    """Whether two sorted arrays of shingles reach the similarity."""
    import numpy as np

    # Each array has distinct values, so equal neighbours of the merged array are shared.
    merged = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((merged[1:] == merged[:-1]).sum())
    return common * 100 >= PERCENT * (len(x) + len(y) - common)


def components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label): the smallest node that each node of the links reaches.

    Each round takes the least label of all neighbours and then the label of
    that label, until nothing changes. A node may have any number of
    neighbours, a label any number of nodes.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = work.save(edges.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), f"{name}-edges")
    near = edges.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("m"))
    labels = work.save(near.select(F.col("u").alias("node"), "degree", F.least("u", "m").alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = join_groups(edges, labels.withColumnRenamed("node", "v"), "v", "degree", ["label"], F.col("u")).groupBy("u").agg(F.min("label").alias("near"))
        own = labels.join(near, F.col("node") == F.col("u")).select("node", "degree", "label", F.least("label", "near").alias("best"))
        own = work.save(own, f"{name}-{step}-near")
        heads = own.groupBy("best").agg(F.count(F.lit(1)).alias("size"))
        heads = work.save(heads.join(own.select("node", F.col("best").alias("head")), F.col("best") == F.col("node")).select("best", "size", "head"), f"{name}-{step}-heads")
        new = join_groups(own, heads, "best", "size", ["head"], F.col("node"))
        new = work.save(new.select("node", "degree", "label", F.least("best", "head").alias("next")), f"{name}-{step}")
        labels = new.select("node", "degree", F.col("next").alias("label"))
        if not new.where("next <> label").limit(1).count():
            return labels.select("node", "label")


#: Members that a hub meets in one task, about.
MEET = 1000


def _calls(pairs: DataFrame) -> DataFrame:
    """(node, calls array<struct<hub, deal>>): where each node of the pairs (a, b) has to be, with ``a`` as the hub.

    A hub with many members is there once for about ``MEET`` of them. A node is
    in no more pairs than its set has shingles in front, or it is a hub.
    """
    degree = pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("deals"))
    own = degree.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"))
    large = degree.where("deals > 1").withColumn("size", F.col("deals") * MEET)
    dealt = join_groups(pairs, large.withColumnRenamed("hub", "a"), "a", "size", ["deals"], F.col("b"))
    others = dealt.select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"))
    return own.unionByName(others).groupBy("node").agg(F.collect_list(F.struct("hub", "deal")).alias("calls"))


def _met(rows: DataFrame, met: Callable, parts: int) -> DataFrame:
    """The pairs (a, b) among rows (hub, deal, node, values...) for which ``met`` holds."""
    first = (F.col("node") != F.col("hub")).cast("int")
    dealt = rows.withColumn("_first", first).repartition(parts, "hub", "deal").sortWithinPartitions("hub", "deal", "_first").drop("_first")
    return dealt.mapInArrow(_meetings(met), _PAIRS)


def verify(pairs: DataFrame, docs: DataFrame, info: DataFrame, members: DataFrame, work: Workspace, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that are linked, compared shingle by shingle.

    Bitmaps drop what cannot be linked; texts are then read again for what is
    left. Either way, each set goes straight to the hubs that it has to meet.
    """
    import numpy as np

    parts = shuffle_partitions(docs.sparkSession)
    told = info.join(_calls(pairs), "node").select(F.inline("calls"), "node", "n", "bits")
    left = work.save(_met(told, lambda x, y: _may_link(*x, *y), parts), f"{name}-bounded")
    asked = _calls(left).join(members.select("node", F.col("first_row").alias("row")), "node")
    # What is asked for grows with the corpus, so it is merged with the sorted texts and never broadcast.
    texts = docs.select("row", "text").join(asked.hint("merge"), "row").select("node", "calls", "text")
    signed = texts.mapInArrow(_signed, "hub long, deal int, node long, shingles binary")
    return work.save(_met(signed, lambda x, y: linked(*(np.frombuffer(v[0], np.uint64) for v in (x, y))), parts), f"{name}-links")


def _frequent(told: DataFrame, work: Workspace) -> list[int]:
    """About ``COMMON`` of the shingles that most documents share.

    Counts are compared by levels; of the last level that takes part, a hash chooses.
    """
    counts = work.save(told.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).withColumn("level", F.floor(F.log2("seen") * 8).cast("int")), "frequent")
    room, cut, share = COMMON, 0, 1.0
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        cut, share = level, min(1.0, room / n)
        room -= n
        if room <= 0:
            break
    chosen = (F.col("level") > cut) | ((F.col("level") == cut) & (F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))))
    return [r["token"] for r in counts.where(chosen).select("token").collect()]


def _shared_buckets(hot: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(bucket, pivot, node) from distinct (key, node) of frequent shingles: named by an aggregate over the nodes, so that no bucket is held in one task."""
    told = hot.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.count(F.lit(1)).alias("n"), F.min("node").alias("pivot")).where("n > 1")
    # Shingles of the same nodes give one bucket.
    told = told.groupBy(F.xxhash64("x", "n", "pivot").alias("bucket")).agg(F.min_by(F.struct("key", "pivot", "n"), "key").alias("k"))
    told = work.save(told.select("bucket", "k.*"), f"{name}-shared-names")
    return join_groups(hot, told, "key", "n", ["bucket", "pivot"], F.col("node")).where("bucket IS NOT NULL").select("bucket", "pivot", "node")


_NODES = "node long, n long, bits binary, prefix binary, shared binary"


def _behind(nodes: DataFrame, hot: DataFrame, docs: DataFrame, members: DataFrame, common: list[int], clashes: frozenset[int], work: Workspace) -> DataFrame:
    """``nodes`` with prefixes in which the shingles of large buckets stand behind rarer ones; ``hot``: (key, node) of these buckets.

    A shingle is large if more than ``HOT`` of the sets in large buckets hold
    it, in front or not. Sets without one in their prefix keep it, as the new
    order has the same shingles first; the others' texts are read again.
    """

    def texts(which: DataFrame) -> DataFrame:
        rows = members.select("node", F.col("first_row").alias("row")).join(which, "node")
        return docs.select("row", "text").join(rows.hint("merge"), "row").drop("row")

    shingles = _all_shingles(common)
    hot = hot.distinct()
    held = texts(hot.select("node").distinct()).select("node", "text").mapInArrow(shingles, "key long, node long")
    large = work.save(held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "large-shingles")
    # Shingles that only now turn out to be large have buckets of at most HOT nodes so far.
    late = large.join(hot.select("key").distinct(), "key", "left_anti")
    front = nodes.select("node", "prefix").mapInArrow(_entries, "key long, node long").join(late, "key", "left_semi").select("node")
    asked = hot.select("node").unionByName(front).distinct()
    held = texts(asked).select("node", "text").mapInArrow(shingles, "key long, node long")
    held = join_groups(held, large, "key", "n", ["n"], F.col("node")).where("n IS NOT NULL")
    moved = work.save(held.groupBy("node").agg(F.collect_list("key").alias("often")), "moved")
    new = texts(moved).select("text", "often").mapInArrow(_prefixes(common, clashes), _NODES)
    return work.save(nodes.join(moved, "node", "left_anti").unionByName(new), "nodes-behind")


def _bucketed(nodes: DataFrame, limit: int | None, work: Workspace, name: str) -> DataFrame:
    """(bucket, pivot, node) of the buckets of prefixes; with a limit, (null, key, node) for those with more nodes."""
    entries = nodes.select("node", "prefix").mapInArrow(_entries, "key long, node long").repartition(shuffle_partitions(work.spark), "key").sortWithinPartitions("key", "node")
    shared = work.save(nodes.where("octet_length(shared) > 0").select("node", "shared").mapInArrow(_entries, "key long, node long").distinct(), f"{name}-shared")
    buckets = entries.mapInArrow(_buckets(limit), "bucket long, pivot long, node long").unionByName(_shared_buckets(shared, work, name))
    buckets = work.save(buckets.distinct(), name)
    work.drop(f"{name}-shared")
    return buckets


def _classes(docs: DataFrame, work: Workspace) -> DataFrame:
    """doc_id, row, n, node (equal for equal sets), component_id of each row of ``docs``: row (unique, written), id, text."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, kind = docs.sparkSession, docs.schema["id"].dataType
    parts = shuffle_partitions(spark)
    told = work.save(docs.select("id", "text", "row").mapInArrow(_describe(to_arrow_type(kind)), _SETS.format(id=kind.simpleString())), "sets")
    common = _frequent(told, work)
    sets = told.where("row IS NOT NULL").select("doc_id", "row", "n", "node", "proof")

    # One row for each set, to read its text again, and the number of rows. Two of 2^32 sets may share a name.
    names = work.save(sets.where("node IS NOT NULL").groupBy("node").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).where("low <> high"), "clashes")
    clashes = frozenset(r["node"] for r in names.select("node").collect())
    if clashes:
        sets = sets.withColumn("node", F.when(F.col("node").isin(*clashes), F.col("proof")).otherwise(F.col("node")))
    members = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("row").alias("first_row"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"))
    members = work.save(members, "members")

    nodes = work.save(docs.select("text").mapInArrow(_prefixes(common, clashes), _NODES), "nodes")
    buckets = _bucketed(nodes, HOT, work, "buckets")
    hot = buckets.where("bucket IS NULL").select(F.col("pivot").alias("key"), "node")
    if hot.limit(1).count():
        nodes = _behind(nodes, hot, docs, members, common, clashes, work)
        work.drop("nodes", "buckets")
        buckets = _bucketed(nodes, None, work, "buckets-behind")
    info = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "n", "bits").dropDuplicates(["node"])
    info = work.save(info, "info")
    work.drop("nodes", "nodes-behind")

    star = buckets.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    star = work.save(star, "star")
    links = verify(star, docs, info, members, work, "first")
    labels = components(links, work, "first")

    named = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("component"))
    named = work.save(named, "named")
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high")
    mixed = work.save(mixed.select("bucket", "size"), "mixed")
    met = join_groups(named, mixed, "bucket", "size", ["size"], F.col("node")).where("size IS NOT NULL")
    marks = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("bucket")), 1, MARKS).alias("marks"))
    rows = met.join(info.join(marks, "node"), "node")
    one = F.lit(0)
    small = rows.where(F.col("size") <= BUCKET).select(F.col("bucket").alias("piece"), "node", "n", "bits", "component", "bucket", one.alias("i"), one.alias("j"), one.alias("own"), "marks")
    dealt = small.unionByName(_pieces(rows.where(F.col("size") > BUCKET), work)).select(*_PIECE)
    dealt = dealt.repartition(parts, "piece").sortWithinPartitions("piece")
    more = dealt.mapInArrow(_pairs_of, _PAIRS).distinct().join(star, ["a", "b"], "left_anti")
    more = verify(work.save(more, "more"), docs, info, members, work, "second")
    labels = components(links.unionByName(more), work, "all")

    joined = members.join(labels, "node", "left").select("node", "first_id", "rows", F.coalesce("label", "node").alias("label"))
    least = joined.groupBy("label").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    least = work.save(least, "least")
    groups = join_groups(joined, least, "label", "size", ["component_id"], F.col("node"))
    groups = work.save(groups.select("node", "rows", "label", "component_id"), "groups")
    found = join_groups(sets, groups, "node", "rows", ["label", "component_id"], F.col("row"))
    return found.select("doc_id", "row", "n", "node", "label", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, row (any unique number), n_shingles, node (equal for equal sets), component_id of each row of ``docs``."""
    work = Workspace(docs.sparkSession, "jaccard-join")
    found = _classes(identified(docs, work, id_col, text_col, False), work)
    return found.select(F.col("doc_id").alias(id_col), "row", F.col("n").alias("n_shingles"), "node", "component_id")


def _pieces(rows: DataFrame, work: Workspace) -> DataFrame:
    """Large buckets as pieces of at most about ``BUCKET`` nodes.

    Nodes outside the bucket's largest component are dealt to q chunks, those
    inside to s; each pair of chunks is a piece, but for two chunks inside.
    """
    rows = work.save(rows, "large")
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("total"))
    main = main.select("bucket", "total", F.col("m.component").alias("main"), F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("m.c")) / (BUCKET // 2))).cast("int").alias("q"), F.greatest(F.lit(1), F.ceil(F.col("m.c") / (BUCKET // 2))).cast("int").alias("s"))
    rows = join_groups(rows, work.save(main, "large-main"), "bucket", "total", ["main", "q", "s"], F.col("node"))
    inside = F.col("component") == F.col("main")
    own = F.when(inside, F.pmod(F.xxhash64("node"), F.col("s"))).otherwise(F.pmod(F.xxhash64("node"), F.col("q"))).cast("int")
    q = F.sequence(F.lit(0), F.col("q") - 1)
    # Outside chunks meet each other as (least, greatest), and inside chunks as (chunk, q + chunk).
    out = F.concat(F.transform(q, lambda k: F.struct(F.least(k, "own").alias("i"), F.greatest(k, "own").alias("j"))), F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda k: F.struct(F.col("own").alias("i"), (F.col("q") + k).alias("j"))))
    within = F.transform(q, lambda k: F.struct(k.alias("i"), (F.col("q") + F.col("own")).alias("j")))
    rows = rows.withColumn("own", own).withColumn("piece", F.explode(F.when(inside, within).otherwise(out)))
    place = F.when(inside, F.col("q") + F.col("own")).otherwise(F.col("own"))
    return rows.select(F.xxhash64("bucket", "piece.i", "piece.j").alias("piece"), "node", "n", "bits", "component", "bucket", "piece.i", "piece.j", place.cast("int").alias("own"), "marks")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: the first row of each component.

    First is the smallest non-null id, then the position. Texts without words
    have no links, and all stay.
    """
    work = Workspace(docs.sparkSession, "jaccard-join")
    rows = identified(docs, work, id_col, text_col, True)
    found = _classes(rows.select("row", "id", "text"), work)
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    kept = found.where("node IS NOT NULL").groupBy("label").agg(F.min(order).alias("k")).select("k.row")
    kept = kept.unionByName(found.where("node IS NULL").select("row"))
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
