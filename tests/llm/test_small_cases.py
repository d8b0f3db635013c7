"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import base64
import bisect
import gzip
import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrascope.llm import ann, bpe, chat_format, exact_dedup, jaccard_join, packing, quality, toxicity, url_filter, warc
from metrascope.llm.common import join_groups
from metrascope.llm.labelled import keep_documents, score_documents
from metrascope.llm.tokens import library_encoder, read_ranks

P = pytest.importorskip("public_tokenizers")

WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(WORDS[i * 7 % 400] for i in range(20_000))
TEXTS = [(1, "a b c d e f g"), (2, "a  b\nc d e f g"), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG + " end"), (1, "a b c d e f g"), (None, "alone here"), (9, "one two"), (10, "two one")]


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have the names that operators use inside."""
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.selectExpr("doc_id", "text", "'x' AS lang", "1 AS row", "2 AS node", "3 AS _key", "'y' AS source", "4 AS label", "5 AS score")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_groups_join_hot_and_cold_rows(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, 0).when(F.col("id") < 990, F.col("id")).alias("k"))
    groups = rows.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("best"))
    got = {r.id: r.best for r in join_groups(rows, groups, "k", "n", ["best"], F.col("id"), hot_groups=10, least=1).collect()}
    assert got == {i: 599 if i < 600 else i if i < 990 else None for i in range(1000)}


def test_exact_dedup(docs, nothing):
    got = exact_dedup.dedup_exact(docs, block=8192).collect()
    assert len(got) == len(TEXTS)
    same = {r.text_sha256: [x for x in got if x.text_sha256 == r.text_sha256] for r in got}
    for rows in same.values():
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(rows)} and len({r.keep_id for r in rows}) == 1
    by = hashlib.sha256(b"abcdefg").hexdigest()
    assert {r.keep_id for r in same[by]} == {2} and len(same[by]) == 3
    assert {r.keep_id for r in same[hashlib.sha256(b"").hexdigest()]} == {5}
    assert exact_dedup.dedup_exact(nothing).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(same)


def test_one_name_a_text(docs):
    """Short blocks give the levels of naming that long texts have."""
    short = docs.withColumn("text", F.left("text", F.lit(60)))
    by_block = [{(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.dedup_exact(short, block=b).collect()} for b in (3, 1 << 20)]
    assert by_block[0] == by_block[1]


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.Example.ORG/es/x?y#z", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/19", "example.org", "/en/19", "example.org/en/1", "block"), ("http://x.org", "x.org", "", None, "allow"), ("x://b.com/de/?q=/fr/", "b.com", "/de/", "com/de/", "block"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://a.com?x/y", "a.com", "", None, "allow"), ("http://É.org/a", "É.org", "/a", "org/", "allow"), ("http:///fr/", "", "/fr/", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    rows = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, host string, rule string")
    got = url_filter.judge_urls(rows, url_filter.rule_table(spark, url_filter.RULES)).collect()
    assert [tuple(r) for r in got] == [(1, host, path, rule, verdict)]


def test_a_long_list_of_rules_gives_the_same(spark, monkeypatch):
    """Above the broadcast's bound, with one rule that most urls fit."""
    urls = [(k, f"http://{'' if k % 3 else 'www.'}example.{'org' if k % 4 else 'com'}/{'es/' if k % 5 else 'fr/'}{k}") for k in range(300)]
    rows, rules = spark.createDataFrame(urls, "page_id long, url string"), url_filter.rule_table(spark, url_filter.RULES)
    told = []
    for most in (url_filter.BROADCAST, 2):
        monkeypatch.setattr(url_filter, "BROADCAST", most)
        told.append(sorted(tuple(r) for r in url_filter.judge_urls(rows, rules).collect()))
    assert told[0] == told[1]


def test_urls_repeat_and_rules_clash(spark):
    rows = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x"), (None, "http://b.net/")], "page_id long, url string")
    rules = url_filter.rule_table(spark, [("net", "/", "allow"), ("net", "/", "block"), ("a.net", "/x", "allow")])
    assert sorted((r.page_id or 0, r.verdict) for r in url_filter.judge_urls(rows, rules).collect()) == [(0, "block"), (1, "allow"), (1, "allow")]
    assert url_filter.judge_urls(rows.where("false"), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(rows, rules.where("false"), default="block").collect()} == {"block"}


def test_chats(spark):
    said = [(1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 1, "assistant", "a\\<|b"), (1, 2, "assistant", None), (1, 2, "assistant", "\\n\\\\"), (2, None, None, "x"), (2, 1, "we\nird\\n", ""), (None, 1, "assistant", "lone")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("ts", F.lit(1))
    out = chat_format.format_chats(rows)
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss_texts, r.formatted) for r in chat_format.parse_chats(out).collect()}
    assert got[1][0] == [("user", said[0][3]), ("assistant", "a\\<|b"), ("assistant", ""), ("assistant", "\\n\\\\")]
    assert got[1][1] == ["a\\<|b", "", "\\n\\\\"] and got[1][2].count("<|im_start|>") == 2
    assert got[2][0] == [("", "x"), ("we\nird\\n", "")] and got[2][1] == []
    assert got[None][1] == ["lone"]
    assert sum(m.chars for m in out.where("conv_id = 1").first().mask) == len(got[1][2])
    assert chat_format.format_chats(rows.where("false")).count() == 0


def test_the_mask_decides_what_is_lost(spark):
    """A mask that lies on another text of the same length gives that text; one that fits no pieces is refused."""
    rows = spark.createDataFrame([(1, 0, "user", "abcd"), (1, 1, "assistant", "wxyz")], "conv_id long, turn long, role string, text string")
    out = chat_format.format_chats(rows)
    moved = out.withColumn("mask", F.transform("mask", lambda m, i: F.struct(m["chars"].alias("chars"), (i == 1).alias("loss"))))
    assert [chat_format.parse_chats(x).first().loss_texts for x in (out, moved)] == [["wxyz"], ["abcd"]]
    for change in (lambda m, i: m["chars"] + F.when(i == 0, 1).when(i == 1, -1).otherwise(0), lambda m, i: m["chars"] + (i == 4).cast("int")):
        broken = out.withColumn("mask", F.transform("mask", lambda m, i: F.struct(change(m, i).cast("int").alias("chars"), m["loss"].alias("loss"))))  # noqa: B023
        with pytest.raises(Exception, match="does not fit"):
            chat_format.parse_chats(broken).collect()


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*[words[i:] for i in range(5)], strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components(texts):
    """Brute force over all pairs of rows."""
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            parent[find(j)] = find(i)
    ids = lambda i: [texts[j][0] for j in range(len(texts)) if find(j) == find(i) and texts[j][0] is not None]
    return sorted((str(d), len(sets[i]), min(ids(i), default=None) if sets[i] else d) for i, (d, _) in enumerate(texts))


def told(df):
    return sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in df.collect())


def test_near_duplicates(docs, nothing):
    assert told(jaccard_join.near_duplicates(docs)) == components(TEXTS)
    assert jaccard_join.near_duplicates(nothing).count() == 0
    kept = jaccard_join.drop_near_duplicates(docs.where("doc_id IN (2, 6, 7, 4, 5, 9)"))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 9]


CLASHING = ("_id", "_sha", "_n", "_key", "row", "doc", "node", "label", "part", "id", "identity", "size", "score")


def test_stages_keep_foreign_columns(spark):
    """Columns with the names that operators use keep their values and types; null and repeated ids, copies and empty texts."""
    copies = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, " a b c d e f g h"), (None, "a b c d e f g h"), (None, "x y z q r"), (None, "x y z q r s t"), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (7, LONG)]
    rows = [(d, t, *[k * 100 + j for j in range(len(CLASHING))]) for k, (d, t) in enumerate(copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in CLASHING))
    by_place = {r[2]: r for r in rows}
    exact = exact_dedup.drop_exact_duplicates(docs)
    near = jaccard_join.drop_near_duplicates(docs)
    for kept, want in ((exact, [[2], [4], [5], [6, 7], [8, 10], [9]]), (near, [[0, 1], [4], [5], [6], [7], [8]])):
        assert kept.dtypes == docs.dtypes
        got = [tuple(r) for r in kept.collect()]
        assert all(by_place[r[2]] == r for r in got)
        places = sorted(r[2] // 100 for r in got)
        assert len(places) == len(want) and all(p in w for p, w in zip(places, want, strict=True))


def test_one_group_of_long_copies_is_dealt_to_all_tasks(spark, monkeypatch):
    """Half of all rows are copies of one text of several blocks: each join of names deals them to several copies of their group."""
    seen = []
    real = exact_dedup.join_groups

    def spy(rows, groups, key, size, values, salt):
        out = real(rows, groups, key, size, values, salt, hot_groups=10, least=10)
        seen.append((key, groups.agg(F.max(size)).first()[0], "_copies" in out._jdf.queryExecution().analyzed().toString()))
        return out

    monkeypatch.setattr(exact_dedup, "join_groups", spy)
    texts = [(k, "same " * 40 if k % 2 else f"own {k} " * 40) for k in range(400)]
    got = exact_dedup.dedup_exact(spark.createDataFrame(texts, "doc_id long, text string"), block=64).collect()
    assert all(r.keep_id == (1 if r.doc_id % 2 else r.doc_id) and r.group_size == (200 if r.doc_id % 2 else 1) for r in got)
    assert len(seen) == 3 and all(largest >= 200 and dealt for _, largest, dealt in seen)


def variants(n, seed=3):
    """A chain of edits, many edits of one text, and texts that share a passage."""
    draw = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(120)]
    rows, now = [], list(base)
    for k in range(n):
        now = list(now)
        now[int(draw.integers(len(now)))] = f"c{k}"
        rows.append(" ".join(now))
        near = list(base)
        for _ in range(int(draw.integers(1, 5))):
            near[int(draw.integers(len(near)))] = f"n{k}-{draw.integers(9)}"
        rows.append(" ".join(near))
        rows.append(" ".join([f"o{k}-{i}" for i in range(60)] + base[:55]))
    return list(enumerate(rows))


@pytest.mark.parametrize("bucket", [2048, 16])
def test_near_duplicates_against_brute_force(spark, monkeypatch, bucket):
    """Small buckets are cut into pieces; the result stays the same."""
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    texts = variants(40)
    assert told(jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))) == components(texts)


def test_shared_passages_fill_no_bucket(spark, monkeypatch):
    """A passage of many texts that no task meets often: all links are found, and hardly anything is compared for its sake."""
    monkeypatch.setattr(jaccard_join, "HOT", 6)
    monkeypatch.setattr(jaccard_join, "LOCAL", 1 << 30)
    compared, verify = [], jaccard_join.verify
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, *rest: compared.append(pairs.count()) or verify(pairs, *rest))
    passage, other = ([f"{mark}{i}" for i in range(60)] for mark in "pq")
    apart = [" ".join([f"a{k}-{i}" for i in range(80)] + passage + [f"b{k}-{i}" for i in range(k)]) for k in range(40)]
    mostly = [" ".join(other + [f"c{k}-{i}" for i in range(k)]) for k in range(40)]  # some linked, some not, none by rare shingles alone
    texts = list(enumerate([*apart, *mostly, *(t for _, t in variants(5)), None, "", "one two", apart[3], mostly[0]]))
    assert told(jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(8))) == components(texts)
    alone = list(enumerate(apart))
    for hot in (8192, 6):
        monkeypatch.setattr(jaccard_join, "HOT", hot)
        assert told(jaccard_join.near_duplicates(spark.createDataFrame(alone, "doc_id long, text string"))) == components(alone)
    assert compared[2] >= 39 and compared[4] == 0  # the first of two comparisons in each run


def test_keys_over_the_limit_are_told_apart():
    """Large buckets come as (null, key, node) across batches, however often a node repeats; others are named."""
    import pyarrow as pa

    keys = np.repeat([1, 2, 3, 4], [9, 4, 1, 12])
    nodes = np.concatenate([np.arange(9), [5, 5, 6, 6], [7], np.arange(12) // 2])
    for cut in (26, 3, 10):
        batches = [pa.record_batch([pa.array(keys[i : i + cut]), pa.array(nodes[i : i + cut])], ["key", "node"]) for i in range(0, 26, cut)]
        rows = [tuple(r.values()) for b in jaccard_join._buckets(5)(iter(batches)) for r in b.to_pylist()]
        assert sorted(r[1:] for r in rows if r[0] is None) == [(1, n) for n in range(9)] + [(4, n) for n in range(6)]
        assert sorted(r[1:] for r in rows if r[0] is not None) == [(5, 5), (5, 6)]
        rows = [tuple(r.values()) for b in jaccard_join._buckets(None)(iter(batches)) for r in b.to_pylist()]
        assert None not in {r[0] for r in rows} and len(rows) == 9 + 2 + 6


def test_slices_of_texts_have_the_same_shingles():
    import pyarrow as pa

    texts = pa.array([None, "", *(f"Ünï WORD{k} Straße {k * 7} a b c d é" * (k % 5) for k in range(900))])
    whole = [s.tolist() for s in jaccard_join.shingle_sets(texts)]
    assert [s.tolist() for i in range(0, 902, 100) for s in jaccard_join.shingle_sets(texts.slice(i, 100))] == whole


def test_signature_trees_lose_no_pair():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate([draw.choice(base, int(draw.integers(150, 300)), replace=False), draw.integers(0, 2**63, int(draw.integers(0, 60))).astype(np.uint64)])) for _ in range(150)]
    found = set()
    for i, j in jaccard_join._candidates(np.arange(150), np.array([len(s) for s in sets]), [jaccard_join.bitmap(s).tobytes() for s in sets], np.arange(150)):
        found |= {frozenset(p) for p in zip(i.tolist(), j.tolist(), strict=True)}
    linked = {frozenset((i, j)) for i, j in itertools.combinations(range(150), 2) if jaccard_join.linked(sets[i], sets[j])}
    assert linked and linked <= found and len(found) < 150 * 149 / 2


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=64).collect()
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
    want = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for _, t in TEXTS if len(x := ids(t)) <= 64)
    assert sorted((r.length, r.ids_crc32) for r in rows if r.piece == 0 and r.doc_id not in (6, 7)) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(sequences) - -(-sum(r.length for r in rows) // 64) <= 1
    long = sorted((r.start, r.length) for r in rows if r.doc_id == 6)
    assert [s for s, _ in long] == [sum(n for _, n in long[:k]) for k in range(len(long))] and {n for _, n in long[1:]} == {64}
    assert packing.pack(nothing, path).count() == 0


def best_fit(lengths, capacity):
    """Sequences of best-fit decreasing, one piece after the other."""
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, length)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        n += gap == capacity
        if gap > length:
            bisect.insort(gaps, gap - length)
    return n


def filled(placed, gaps=()):
    """Checks that pieces stand gapless in their sequences, and gives what each holds."""
    held = {}
    for _, length, at, offset in placed:
        held.setdefault(at, []).append((offset, length))
    for at, parts in held.items():
        start = dict(gaps).get(at, 0)
        for offset, length in sorted(parts):
            assert offset == start
            start += length
    return {at: sum(n for _, n in parts) for at, parts in held.items()}


def test_a_sweep_is_best_fit_decreasing():
    draw = np.random.default_rng(12)
    for n in (1, 5, 60, 800):
        lengths = draw.integers(1, 101, n).tolist()
        rows = sorted(((packing._PIECE, k, x) for k, x in enumerate(lengths)), key=lambda r: -r[2])
        placed, left, gaps, small = packing.sweep(iter(rows), 100, itertools.count())
        assert not left and sorted(k for k, *_ in placed) == list(range(n))
        held = filled(placed)
        assert max(held.values()) <= 100 and len(held) == best_fit(lengths, 100)
        assert dict(gaps + small) == {at: 100 - n for at, n in held.items() if n < 100}


def test_a_sweep_takes_the_smallest_gap_that_holds_a_piece():
    piece, gap = packing._PIECE, packing._GAP
    placed, left, gaps, small = packing.sweep(iter([(piece, 1, 90), (gap, 7, 80), (gap, 8, 60), (piece, 2, 50), (piece, 3, 50), (piece, 4, 40), (gap, 9, 20)]), 100)
    assert left == [(1, 90), (4, 40)] and [(k, at, offset) for k, _, at, offset in placed] == [(2, 8, 40), (3, 7, 20)]
    assert gaps == [(9, 20), (7, 30)] and small == [(8, 10)] or dict(gaps + small) == {9: 20, 7: 30, 8: 10}


def test_ranges_match_by_rank():
    """Pieces of a range take the gaps of the nearest earlier range that has some left."""
    got = packing.match_ranges([(0, 3, 5), (1, 0, 2), (2, 4, 1), (3, 1, 0), (4, 9, 0)])
    assert got == [(2, 0, 1, 0, 2), (2, 2, 0, 0, 2), (3, 0, 2, 0, 1), (4, 0, 0, 2, 3)]


def test_length_ranges_cover_all_lengths():
    counts = {n: 3 for n in range(1, 2049)}
    for most in (1, 50, 10**6):
        got = packing.length_ranges(counts, 2048, most)
        assert got[0][1] == 2048 and got[-1][0] == 0 and all(x[0] == y[1] for x, y in zip(got[:-1], got[1:], strict=True)) and sum(n for *_, n in got) == 3 * 2048
    assert len(packing.length_ranges(counts, 2048, 10**6)) == 1


def test_packing_over_many_ranges(spark, monkeypatch):
    """Ranges of a few rows: pieces meet gaps of other ranges, and there are hardly more sequences than one task would make."""
    monkeypatch.setattr(packing, "RANGE", 60)
    draw = np.random.default_rng(13)
    texts = [(k, "word " * int(n)) for k, n in enumerate(draw.integers(0, 90, 700))]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), P.path("byte_bpe_50k.json"), capacity=64).collect()
    assert {r.doc_id for r in rows} == set(range(700))
    held = filled([(r.doc_id, r.length, r.sequence_id, r.offset) for r in rows])
    assert max(held.values()) <= 64 and len(held) <= 1.02 * best_fit([r.length for r in rows], 64)


def test_ranges_follow_the_rows_and_not_the_partitions(spark, tmp_path, monkeypatch):
    """Two shuffle partitions, some forty ranges: no task sweeps more than twice ``RANGE`` rows."""
    from metrascope.llm.common import Workspace

    monkeypatch.setattr(packing, "RANGE", 100)
    draw = np.random.default_rng(14)
    lengths = [int(x) for x in draw.integers(134, 201, 4000)]  # a round: a half to a third of the capacity
    units = spark.createDataFrame(list(enumerate(lengths)), "id long, size int")
    work, before = Workspace(spark, "ranges"), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        placed, gaps = packing._round(units, units.where("false"), 4000, 400, 0, work)
        rows = placed.collect()
        swept = spark.read.parquet(f"{work.path}/swept0").groupBy("part").count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(swept) >= 35 and max(r["count"] for r in swept) <= 200
    held = filled([(r["id"], r["size"], r["at"], r["offset"]) for r in rows])
    assert sorted(r["id"] for r in rows) == list(range(4000)) and max(held.values()) <= 400
    assert len(held) <= 1.01 * best_fit(lengths, 400) + 1


def test_bpe_round_trip(docs, nothing):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trips(docs, path, P.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(d), len(e := encoding.encode_ordinary(t or "")), sha(np.array(e, "<u4").tobytes()), sha((t or "").encode())) for d, t in TEXTS)
    assert got == want
    assert bpe.encode_documents(nothing, path, P.PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_odd_texts_are_encoded_as_the_libraries_do(name):
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    draw = np.random.default_rng(2)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", ".", "1", "'s", "\xa0", "_", "中", "\r\n", "   ", "\n\n", "\x0b", "<|endoftext|>", "🎉", "ﬁ"]
    texts = ["".join(draw.choice(parts, int(draw.integers(0, 9)))) for _ in range(4000)]
    if name.endswith("json"):
        tokenizer, encoder = Tokenizer.from_file(P.path(name)), library_encoder(P.path(name))
        tokenizer.encode_special_tokens = True
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    else:
        encoding = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path(name)), special_tokens={})
        encoder, want = bpe.codec(P.path(name), P.PATTERN).encoder, [encoding.encode_ordinary(t) for t in texts]
    assert [list(memoryview(b).cast("I")) for b in encoder.texts(pa.array(texts))] == want


def test_warc(spark, tmp_path):
    pages = [(3, "http://a/ b", "x" * 50_000), (1, None, "same"), (2, "u", "same"), (2, "u", "same"), (5, "u", None), (4, "é\n", ""), (None, "n", "only null"), (None, "n", "same"), (7, "w", "\r\n\r\nWARC/1.1\r\n0\r\n\r\n")]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    warc.write_archives(rows, str(tmp_path / "w"), segment_bytes=1000, file_bytes=4000)
    got = sorted(warc.read_archives(spark, str(tmp_path / "w")).collect(), key=str)
    b32 = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    first = {t: min((i for i, _, u in pages if (u or "") == t and i is not None), default=None) for t in {u or "" for _, _, u in pages}}
    want = []
    for i, _, t in pages:
        t = t or ""
        revisit = first[t] is not None and first[t] != i
        want.append((i, len(t.encode()), b32(t), "revisit" if revisit else "response", first[t] if revisit else None, None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    warc.write_archives(rows.where("false"), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives_do_not_stop_a_reader(spark, tmp_path):
    """Cut off, garbage, empty, without an id, and an empty folder."""
    record = lambda k: b"".join(warc.page_records(f"<urn:uuid:{k}>", k, "u", b"payload", None))
    packed = gzip.compress(record(8)) + gzip.compress(record(9))
    files = {"packed": packed, "torn": gzip.compress(record(10)) + gzip.compress(record(11))[:-12], "good": record(1) + record(2), "cut": record(3) + record(4)[:-30], "garbage": b"\x00\xff nothing", "empty": b"", "nameless": record(5) + record(6).replace(b"WARC-Record-ID", b"X-Record"), "negative": record(7).replace(b"Content-Length: 1", b"Content-Length: -1", 1)}
    (tmp_path / "damaged").mkdir()
    for name, data in files.items():
        (tmp_path / "damaged" / name).write_bytes(data)
    got = warc.read_archives(spark, str(tmp_path / "damaged")).collect()
    assert sorted(r.page_id for r in got if r.problem is None) == [1, 2, 3, 5, 8, 9, 10]
    told = [r.problem for r in got if r.problem]
    assert len(told) == 5 and all(any(name in x for x in told) for name in ("cut", "garbage", "nameless", "negative", "torn"))
    (tmp_path / "none").mkdir()
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_broken_archives_are_told():
    (record,) = warc.page_records("<urn:uuid:1>", 1, "u", b"payload", None)
    ((fields, block),) = warc.parse_records(record)
    assert warc._told(fields, block)[1:3] == (7, warc.base32_sha1(b"payload"))
    assert warc._told(fields, block.replace(b"payload", b"PAYLOAD"))[5] == "the digest differs"
    assert warc._told(fields, block.replace(b"7\r\n", b"6\r\n"))[5]
    with pytest.raises(ValueError, match="does not end"):
        list(warc.parse_records(record[:-2]))
    parts = list(warc.page_records("<urn:uuid:2>", 2, "u", b"y" * 5000, None, 1000))
    assert len(parts) > 4 and b"WARC-Segment-Total-Length" in parts[-1]


def test_nearest(spark):
    draw = np.random.default_rng(4)
    x = draw.standard_normal((300, 16))
    x[50] = x[51]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15), (904, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (50, [float(v) for v in x[50]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = {}
    for r in ann.search(df, df.where("vec_id % 50 = 0 OR vec_id > 800")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = ann.brute_force(x, np.arange(300), [0, 50, 100, 150, 200, 250])
    assert set(got) == set(want) and all([k for k, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len({v for _, v, _ in got[q]} & set(want[q])) for q in want)
    assert hits >= 0.9 * 5 * len(want) and sorted(got[50])[0][1:] == (51, pytest.approx(1.0))
    assert ann.search(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2
    assert ann.search(df.where("false"), df).count() == 0


def test_pigeonhole_finds_every_code_within_the_radius():
    codes = np.random.default_rng(5).integers(0, 1 << 16, (3000, ann.PARTS)).astype(np.uint16)
    for i in range(1, 50):
        codes[i] = codes[0]
        for b in range(i):
            codes[i, b * 5 % ann.PARTS] ^= np.uint16(1 << (b * 7 % 16))
    index = ann.SubstringIndex(codes)
    for radius in (0, 3, 9, 26, 50):
        found = index.within(codes[0], radius, [ann._masks(16, r) for r in ann.reaches(radius)])
        assert set(found.tolist()) == set(np.flatnonzero(ann.distances(codes, codes[0]) <= radius).tolist())


def clusters(n=40, each=8, dim=48):
    """Groups of near vectors, far from each other: the radius that is learned is narrow."""
    draw = np.random.default_rng(14)
    x = np.repeat(draw.standard_normal((n, dim)), each, axis=0)
    return x + 0.01 * draw.standard_normal(x.shape)


def test_both_ways_to_probe_find_the_same(spark, monkeypatch):
    x = clusters()
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    told = []
    for probes in (ann.PROBES, -1):
        monkeypatch.setattr(ann, "PROBES", probes)
        told.append(sorted(tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()))
    assert told[0] == told[1]
    want = ann.brute_force(x, range(len(x)), range(0, len(x), 20))
    assert {(q, v) for q, _, v, _ in told[0]} == {(q, v) for q, vs in want.items() for v in vs}


def test_both_widths_of_substrings_find_every_code_within_the_radius(spark, monkeypatch):
    """A cluster of most rows, whose keys are dealt out, and rows of no cluster; against all distances of codes."""
    from metrascope.llm import common
    from metrascope.llm.common import Workspace

    assert [ann.join_parts(r, n) for r, n in ((7, 1000), (7, 1 << 30), (20, 1 << 30), (60, 1 << 30))] == [8, 4, 8, None]
    draw = np.random.default_rng(15)
    x = np.concatenate([draw.standard_normal(32) + 0.05 * draw.standard_normal((700, 32)), draw.standard_normal((100, 32))])
    codes = ann.fit(x)
    codes.radius = 6
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    asked = [0, 5, 699, 701, 702]
    coded = codes(ann.unit_rows(x))
    want = {(q, int(v)) for q in asked for v in np.flatnonzero(ann.distances(coded, coded[q]) <= 6) if v != q}
    for parts, least in ((8, 20), (4, 20), (4, 10**6)):
        monkeypatch.setattr(ann, "join_dealt", lambda *a, least=least, **b: common.join_dealt(*a, **b, least=least))
        got = [(r.query_id, r.vec_id) for r in ann._joined(df, df.where(F.col("id").isin(asked)), codes, parts, Workspace(spark, "widths")).collect()]
        assert len(got) == len(want) and set(got) == want
    assert len(want) > 100


def test_a_dealt_join_is_a_join(spark):
    many = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).when(F.col("id") < 990, F.col("id")).alias("k"))
    few = spark.createDataFrame([(1, "a"), (1, "b"), (800, "c"), (5, "never")], "k int, v string")
    from metrascope.llm.common import join_dealt

    for least in (10, 10**6):
        got = join_dealt(many, few, "k", F.col("id"), hot_keys=10, least=least)
        assert sorted((r.id, r.v) for r in got.collect()) == sorted([(i, v) for i in range(700) for v in "ab"] + [(800, "c")])


def test_blocks_of_queries(spark, monkeypatch):
    """Few queries a block and few rows an index give what one of each gives."""
    draw = np.random.default_rng(16)
    x = draw.standard_normal((400, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    whole = sorted(tuple(r) for r in ann.search(df, df.where("vec_id % 10 = 0")).collect())
    monkeypatch.setattr(ann, "QUERY_BYTES", 24 * 8 * 7)
    monkeypatch.setattr(ann, "ROWS", 50)
    assert sorted(tuple(r) for r in ann.search(df, df.where("vec_id % 10 = 0")).collect()) == whole and len(whole) == 200
    assert ann.search(df, df.where("false")).count() == 0


def test_a_vector_that_most_rows_have(spark):
    """Ties go to the smallest ids, and rows that repeat an id count once."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(60)] + [(7, [1.0, 2.0, 3.0])] * 5 + [(100 + i, [float(i), 1.0, 0.5]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id IN (3, 50, 110)")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [v for _, v in sorted(got[3])] == [0, 1, 2, 4, 5] and [v for _, v in sorted(got[50])] == [0, 1, 2, 3, 4] and len(got[110]) == 5


def labelled(n=600):
    draw = np.random.default_rng(6)
    texts, toxic, good = [], [], []
    for k in range(n):
        words = [f"word{draw.integers(300)}" for _ in range(60)]
        bad = k % 5 == 0
        if bad:
            words[int(draw.integers(60))] = "nasty" + "abc"[k % 3]
        text = ". ".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, 60, 12)) + "."
        poor = k % 4 == 0
        texts.append(" !! ".join(words).upper() if poor else text)
        toxic.append(int(bad))
        good.append(int(not poor))
    return texts, toxic, good


def test_toxicity(docs, nothing, spark):
    texts, toxic, _ = labelled()
    model = toxicity.fit(texts[:400], toxic[:400])
    import pyarrow as pa

    score = model.score(pa.array(texts[400:]))["score"]
    assert ((score >= 0.5) == np.array(toxic[400:], bool)).mean() > 0.95
    rows = score_documents(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert score_documents(nothing, model).count() == 0
    df = spark.createDataFrame([(1, "All is well. You nastya fool here. Fine."), (2, None)], "doc_id long, text string")
    assert [(r.doc_id, r.sentence) for r in toxicity.locate_sentences(df, model).collect()] == [(1, 1)]
    assert keep_documents(docs, model, lambda s: s >= 0).columns == docs.columns
    assert toxicity.fit([], []).constant == 0.5 and toxicity.fit(["a"], [1]).constant == 1.0


def test_quality(docs, nothing):
    texts, _, good = labelled()
    model = quality.fit(quality.feature_matrix(texts[:400]), good[:400])
    import pyarrow as pa

    score = model.score(pa.array(texts[400:]))["score"]
    assert ((score >= 0.5) == np.array(good[400:], bool)).mean() > 0.97
    rows = score_documents(docs, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert score_documents(nothing, model).count() == 0
    assert quality.fit(np.zeros((0, 14)), []).constant == 0.5


def test_labels_with_nulls_and_repeats(spark, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 0), (10, 5)], "doc_id long, toxic int")
    from metrascope.llm.labelled import labelled_sample

    got = sorted((r["_doc"], r["label"]) for r in labelled_sample(docs, labels, "toxic", F.lit(True), 10).collect())
    few = labelled_sample(docs, labels, "toxic", F.lit(True), 10, most_chars=10)
    assert sorted((r["_doc"], r["label"]) for r in few.collect()) == [(1, 1), (9, 0)]
    assert got == [(1, 1), (9, 0)]


def test_a_long_text_keeps_no_label_out(spark):
    """Whichever text is made long, all others of its label stay in the sample; a label of long texts only has its shortest."""
    from metrascope.llm.labelled import labelled_sample

    ids = list(range(40))
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    for long in (0, 1, 7, 22, 39):
        docs = spark.createDataFrame([(i, "a few words " * (2000 if i == long else 3)) for i in ids], "doc_id long, text string")
        got = {r["_doc"] for r in labelled_sample(docs, labels, "toxic", F.lit(True), 100, most_chars=20_000).collect()}
        assert got == {*ids} - {long}
    docs = spark.createDataFrame([(i, "a few words " * (2000 + i if i % 2 else 3)) for i in ids], "doc_id long, text string")
    got = {r["_doc"] for r in labelled_sample(docs, labels, "toxic", F.lit(True), 100, most_chars=20_000).collect()}
    assert got == {1, *range(0, 40, 2)}


def insulting(join, word="nastya"):
    """A line of 40 words, the last but one of them toxic."""
    return join.join([*(f"word{k}" for k in range(38)), word, "word39"])


@pytest.fixture(scope="module")
def toxic_model():
    texts, toxic, _ = labelled()
    return toxicity.fit(texts, toxic)


@pytest.mark.parametrize("join", ["\t", "\r", "\x0c", "\xa0", "\u3000", ",", "/", "_", ""])
def test_toxic_words_count_wherever_they_stand(spark, toxic_model, join):
    """Behind tabs and other white space, behind punctuation, and in a run without spaces."""
    import pyarrow as pa

    bad, clean, spaced = toxic_model.score(pa.array([insulting(join), insulting(join, "word38"), insulting(" ")]))["score"]
    assert bad > 10 * clean and (not join.isspace() or bad == pytest.approx(spaced))
    df = spark.createDataFrame([(1, insulting(join)), (2, insulting(join, "word38"))], "doc_id long, text string")
    found = toxicity.locate_sentences(df, toxic_model, least=min(bad * 0.9, 0.5)).collect()
    assert {r.doc_id for r in found} == {1} and any("nasty" in r.text for r in found)


def test_toxicity_of_texts_without_spaces():
    """An insult anywhere in lines of Han characters without punctuation, and sentences by their own full stop."""
    import pyarrow as pa

    draw = np.random.default_rng(8)
    chars = [chr(0x4E00 + k) for k in range(200)]
    line = lambda n: "".join(draw.choice(chars, n))
    make = lambda bad: line(int(draw.integers(70, 150))) + ("龘靐" if bad else "") + line(20)
    toxic = [k % 3 == 0 for k in range(450)]
    texts = [make(t) for t in toxic]
    score = toxicity.fit(texts[:300], toxic[:300]).score(pa.array(texts[300:]))["score"]
    assert ((score >= 0.5) == np.array(toxic[300:])).mean() > 0.95
    assert toxicity.split_sentences(pa.array(["一二。三四！五", "a b"]))[3].tolist() == [0, 0, 0, 1]


def test_the_last_word_of_10000_characters_counts(toxic_model):
    """A run without spaces whose last word is toxic, against the same run without it."""
    import pyarrow as pa

    run = "".join(f"word{k % 300}" for k in range(1500))[:10_000]
    bad, clean = toxic_model.score(pa.array([run + "nastyb", run + "word38"]))["score"]
    assert bad > 0.5 and bad > clean + 0.2


@pytest.mark.parametrize("joined", ["you,nastyc", "you.nastyc", "(nastyc)", "you_nastyc", "so-nastyc!", "you/nastyc"])
def test_punctuation_parts_words(joined):
    word = set(toxicity.word_features("nastyc"))
    assert word <= set(toxicity.word_features(joined))


def test_cut_pieces_are_whole():
    for piece in ("ab" * 500, "x" * 65, "a," * 100, "http://a.b/" + "c" * 300 + "?" + "d" * 10, "。" * 70):
        parts, ends = toxicity.cut_piece(piece)
        assert len(parts) == len(ends) and max(map(len, parts)) <= 64
        grams = lambda t: {t[i : i + 6] for i in range(len(t) - 5)}
        runs = toxicity._RUN.findall(piece)
        assert "".join(runs) == piece and all(grams(r) <= set().union(*map(grams, parts)) for r in runs)


def test_quality_threshold_does_not_depend_on_the_sample(spark):
    """Overlapping scores, 9 of 10 rows good: a sample of as many of either label cuts near where all rows do."""
    draw = np.random.default_rng(9)
    rows = []
    for k in range(8000):
        poor = k % 10 == 0
        marks = draw.random() < (0.8 if poor else 0.2)
        words = [f"word{draw.integers(300)}{'!' if marks and draw.random() < draw.random() else ''}" for _ in range(40)]
        rows.append((k, " ".join(words), int(not poor)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4).cache()
    import pyarrow as pa

    texts = pa.array([t for _, t, _ in rows])
    share = lambda model: float((model.score(texts)["score"] < 0.5).mean())
    every, part = (share(quality.fit_on(df.drop("quality"), df.drop("text"), n)) for n in (10_000, 800))
    assert abs(every - 0.1) < 0.01 and abs(part - 0.1) < 0.05


def test_label_counts(spark, docs):
    from metrascope.llm.labelled import label_counts

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 0), (10, 5), (77, 0)], "doc_id long, toxic int")
    assert label_counts(docs, labels, "toxic", F.lit(True)) == (1, 2)


def test_all_of_4000_toxic_documents_take_part(spark):
    """A word in 6 of 4,000 toxic documents needs them all to reach LEAST_DOCS."""
    from metrascope.llm.labelled import labelled_sample

    assert toxicity.PER_CLASS >= 4000
    n = 4000
    docs = spark.range(n).selectExpr("id AS doc_id", "'x' AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS toxic")
    assert labelled_sample(docs, labels, "toxic", F.lit(True), toxicity.PER_CLASS).count() == n


def test_the_fit_of_a_task_is_that_of_its_texts(spark):
    texts, toxic, _ = labelled(200)
    df = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(zip(texts, toxic, strict=True))], "doc_id long, text string, toxic int").repartition(3)
    own = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    model, want = toxicity.fit_on(df, df.drop("text")), toxicity.fit([texts[k] for k in own], [toxic[k] for k in own])
    np.testing.assert_allclose(model.weights, want.weights, atol=1e-4)
    assert toxicity.fit_on(df.where("false"), df.drop("text")).constant == 0.5
    assert toxicity.fit_on(df, df.drop("text").where("toxic = 1")).constant == 1.0


def test_fit_does_not_depend_on_slices(monkeypatch):
    texts, toxic, _ = labelled(200)
    fits = []
    for most in ((256, 1 << 18), (7, 50)):
        monkeypatch.setattr(toxicity, "_TEXTS", most[0])
        monkeypatch.setattr(toxicity, "_PLACES", most[1])
        fits.append(toxicity.fit(texts, toxic, rounds=40))
    np.testing.assert_allclose(fits[0].weights, fits[1].weights, atol=1e-4)
    assert fits[0].intercept == pytest.approx(fits[1].intercept, abs=1e-4)


def test_control_strings_are_tokens_as_by_the_librarys_default(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), library_encoder(path, added=True)
    draw = np.random.default_rng(10)
    parts = [" ", "  ", "\n", "a", "B", "é", ".", "1", "'s", "\xa0", "中", "   ", "<|endoftext|>", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["<|endoftext|>", "", *("".join(draw.choice(parts, int(draw.integers(0, 9)))) for _ in range(3000))]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [50256]
    assert [list(memoryview(b).cast("I")) for b in encoder.texts(pa.array(texts))] == want
    rows = packing.pack(spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string"), path).collect()
    ids = tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids + [0]
    assert [(r.length, r.ids_crc32) for r in rows] == [(len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))]
