"""Registered queries of the operators against SQL, brute force and held-out labels, and the pipeline stage by stage."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrascope.llm import ann, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(agree, name):
    agree(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.fixture(scope="module")
def larger():
    """Enough labels for a share of held-out ones to tell something."""
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "modulo", "rest", "value"), [("op1_quality", "quality", 3, 1, 0), ("op10_toxicity", "toxic", 5, 0, 1)])
def test_held_out_labels(spark, larger, duck, name, label, modulo, rest, value):
    """On held-out rows alone: better than the majority, and most rows of the rarer label are found."""
    rows = queries.QUERIES[name](spark, larger).collect()
    assert len(rows) == duck.execute(f"SELECT count(*) FROM '{larger}/documents.parquet'").fetchone()[0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulo == rest) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    truth = dict(duck.execute(f"SELECT doc_id, {label} FROM '{larger}/labels.parquet'").fetchall())
    y, told = (np.array(x) for x in zip(*[(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth], strict=True))
    majority = max(np.mean(y), 1 - np.mean(y))
    assert np.mean(y == told) > majority + 0.4 * (1 - majority)
    assert np.mean(told[y == value] == value) > 0.6 and np.mean(y[told == value] == value) > 0.6


def test_tokens_are_those_of_the_libraries(spark, sf, duck):
    """The registered queries of packing and of byte-level BPE over all documents."""
    import public_tokenizers as P
    import tiktoken
    from test_small_cases import best_fit, filled
    from tokenizers import Tokenizer

    from metrascope.llm.tokens import read_ranks

    texts = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {d: np.array([*e.ids, 0], "<u4") for (d, _), e in zip(texts, own.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True)}
    rows = queries.QUERIES["op7_best_fit_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.start) for r in rows if r.piece == 0) == [(d, 0) for d in sorted(ids)]
    for r in rows:
        assert r.length <= 2048 and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    held = filled([(r.doc_id, r.length, r.sequence_id, r.offset) for r in rows])
    assert max(held.values()) <= 2048 and len(held) == best_fit([r.length for r in rows], 2048)

    multi = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((d, len(e), sha(np.array(e, "<u4").tobytes()), sha(t.encode())) for (d, t) in texts for e in [multi.encode_ordinary(t)])
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op9_byte_bpe"](spark, sf).collect()) == want


def test_recall_of_nearest(spark, sf, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    x, ids = np.array([r[1] for r in rows], float), [r[0] for r in rows]
    want = ann.brute_force(x, ids, [i for i in ids if i % 50 == 0])
    got = {}
    for r in queries.QUERIES["op2_multi_index_hashing"](spark, sf).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_near_duplicates_against_brute_force(spark, sf, duck):
    from test_small_cases import components, told

    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert told(queries.QUERIES["op6_jaccard_join"](spark, sf)) == components(texts)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n, ids = docs.columns, docs.count(), set()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if k < 4:
            docs = docs.cache()
            assert docs.columns == columns and 0.3 * n < docs.count() <= n
            ids, n = {r.doc_id for r in docs.select("doc_id").collect()}, docs.count()
    assert {r.doc_id for r in docs.select("doc_id").collect()} == ids


def test_stages_take_odd_tables(spark, sf, tmp_path):
    """Nulls in any column, repeated ids, extra columns, and no rows at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(30).selectExpr("CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 1 ELSE doc_id END AS doc_id", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS text", "CAST(NULL AS STRING) AS lang", "source", "n_chars", "1 AS row")
    for k, rows in enumerate((odd, docs.where("false"))):
        rows.coalesce(1).write.parquet(str(tmp_path / f"docs{k}"))
        rows = spark.read.parquet(str(tmp_path / f"docs{k}"))
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, rows, sf)
            if j < 4:
                assert out.dtypes == rows.dtypes
                out.write.parquet(str(tmp_path / f"docs{k}-{j}"))
                rows = spark.read.parquet(str(tmp_path / f"docs{k}-{j}"))
            else:
                assert out.where("piece = 0").count() == rows.count()


def test_stages_take_dotted_names_and_long_texts(spark, sf, tmp_path):
    """Columns with dots, quotes and blanks in their names keep their values through every stage; so does a text of a million characters."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(140_000))
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").limit(25)
    odd = docs.withColumns({"a.b": F.col("doc_id") + 1, "c`d e": F.col("lang"), "doc": F.lit("x"), "label": F.lit(3)})
    odd = odd.withColumn("text", F.when(F.col("doc_id") == F.lit(docs.first().doc_id), F.lit(long)).otherwise(F.col("text")))
    odd.coalesce(1).write.parquet(str(tmp_path / "docs"))
    rows = spark.read.parquet(str(tmp_path / "docs"))
    ids = {r.doc_id for r in rows.collect()}
    for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, sf)
        if j < 4:
            assert out.columns == odd.columns
            out.write.parquet(str(tmp_path / f"docs{j}"))
            rows = spark.read.parquet(str(tmp_path / f"docs{j}"))
            told = rows.collect()
            assert told and {r["doc_id"] for r in told} <= ids and all(r["a.b"] == r["doc_id"] + 1 and r["c`d e"] == r["lang"] for r in told)
        else:
            assert out.where("piece = 0").count() == len(told)
