"""Rates, sessions, selections, labels, agreement and streams on small tables."""

import json
import math

import pytest
from pyspark.sql import functions as F

from metrascope.functions import parse as P
from metrascope.functions import stats as T
from metrascope.operators import agreement as A
from metrascope.operators import labels as B
from metrascope.operators import prevalence as R
from metrascope.operators import selection as S
from metrascope.operators import sessions as W
from metrascope.plans import release
from metrascope.streaming import weekly


def test_wilson(spark):
    df = spark.createDataFrame([(0, 0), (5, 10), (0, 200), (200, 200)], "k int, n int").select(T.wilson_bound(F.col("k"), F.col("n"), -1), T.wilson_bound(F.col("k"), F.col("n"), 1))
    (a, b), (c, d), (e, f), (g, h) = df.collect()
    assert (a, b, e, h) == (0, 0, 0, 1)
    assert 0.23 < c < 0.24 and 0.76 < d < 0.77 and 0.018 < f < 0.020 and g > 0.98


def test_parsing(spark):
    df = spark.createDataFrame([(" 7 ",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(P.optional_int(F.col("c"), "c")).collect()] == [7, None, None]
    flags = spark.createDataFrame([("Yes",), ("0",), (None,), (" true",)], "c string")
    assert [r[0] for r in flags.select(P.truthy(F.col("c"))).collect()] == [True, False, False, True]
    versions = spark.createDataFrame([("2.7",), ("2.10",), ("3",)], "c string")
    assert [r[0] for r in versions.select(P.version_at_least(F.col("c"), 2, 8)).collect()] == [False, True, True]


def test_costs(spark):
    df = spark.sql("SELECT map('in', 1000000L, 'out', 2L) AS t, map('in', 3.0D, 'out', 5.0D) AS r")
    assert df.select(T.cost(F.col("t"), F.col("r"))).first()[0] == pytest.approx(3.00001)
    with pytest.raises(Exception, match="no rate"):
        df.select(T.cost(F.col("t"), F.create_map(F.lit("in"), F.lit(1.0)))).collect()


def test_chains_and_anchors_differ(spark):
    at = [0, 500, 1000, 1500, 2600, 5000]
    df = spark.createDataFrame([(1, i, x, "t", f"c{i}" * (i + 1)) for i, x in enumerate(at)], "d int, id int, offset int, term string, context string")
    chains = W.merge_snippets(df, ["d"]).orderBy("session").collect()
    assert [r.hit_ids for r in chains] == [[0, 1, 2, 3], [4], [5]]
    assert chains[0].context == "c3" * 4
    assert [(r.block_low, r.block_high, r.n) for r in W.anchored_blocks(df, ["d"], "offset").orderBy("block_low").collect()] == [(0, 2600, 5), (5000, 5000, 1)]


def test_intervals_touch(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 10, 11)], "d int, lo int, hi int")
    assert sorted((r.lo, r.hi, r.n) for r in W.interval_union(df, ["d"], "lo", "hi").collect()) == [(0, 7, 2), (9, 12, 2)]


def test_ok_settles_and_stays(spark):
    df = spark.createDataFrame([(1, 1, "error"), (1, 2, "ok"), (1, 3, "ok"), (2, 4, "error"), (2, 5, "bad")], "k int, seq int, status string")
    assert sorted((r.k, r.seq) for r in W.settle(df, ["k"], "status", "seq").collect()) == [(1, 2), (2, 4)]


def test_artifacts(spark):
    versions = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("c", 2)], "arxiv_id string, version int")
    held = spark.createDataFrame([("a", 1, "pdf", 1), ("a", 1, "src", 2), ("b", None, "src", 3), ("c", None, "src", 4), ("c", 2, "src", 5)], "arxiv_id string, version int, kind string, id int")
    got = {(r.arxiv_id, r.id, r.basis) for r in S.pick_artifacts(held, versions).collect()}
    assert got == {("a", 2, "explicit-v1"), ("b", 3, "inferred-single-version")}


def test_strata(spark):
    df = spark.createDataFrame([(None, None), (2, None), (1, "inferred-single-version"), (1, None)], "v int, b string")
    assert [r[0] for r in df.select(S.version_stratum(F.col("v"), F.col("b"))).collect()] == ["unknown", "later", "v1_inferred", "v1"]


def test_each_paper_has_one_state(spark):
    frame = spark.createDataFrame([(x,) for x in "abcde"], "arxiv_id string")
    items = spark.createDataFrame([("a", "ok"), ("b", "error:X")], "arxiv_id string, status string")
    files = spark.createDataFrame([("c", "error"), ("d", "error"), ("d", "ok:src"), ("a", "error")], "arxiv_id string, status string")
    assert {r.arxiv_id: r.state for r in S.coverage(frame, items, files).collect()} == dict(zip("abcde", ["scanned", "scan_error", "fetch_failed", "fetched_not_in_run", "unfetched"], strict=True))


def test_kappa(spark):
    def of(*pairs):
        return A.agreement(spark.createDataFrame(list(pairs), "a string, b string"), "a", "b").first()

    assert of(("x", "x"), ("y", "y")).kappa == pytest.approx(1)
    assert of(("x", "x"), ("x", "y")).kappa == 0
    assert math.isnan(A.agreement(spark.createDataFrame([], "a string, b string"), "a", "b").first().kappa)
    assert math.isnan(of(("x", "x"), ("x", "x")).kappa)  # chance agrees fully, so agreement tells nothing


def test_sample_is_exact_and_repeatable(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 5, "POS").when(F.col("id") < 30, "FLAG").otherwise("NEG").alias("s"))
    draw = lambda: {(r.s, r.id, r.frame_n, r.n, round(r.inclusion_p, 3)) for r in A.stratified_sample(rows, "s", "id", {"POS": 10, "FLAG": 10, "NEG": 7}, 42).collect()}
    got = draw()
    assert got == draw()
    assert {(s, f, n, p) for s, _, f, n, p in got} == {("POS", 5, 5, 1.0), ("FLAG", 25, 10, 0.4), ("NEG", 70, 7, 0.1)}
    assert len(got) == 22


GOOD = {"polarity": "author_use", "tools": [" GPT "], "models": [], "categories": ["ideation"], "epistemic_impact": "supportive", "locations": ["body"], "confidence": 0.5, "quote": "we asked it", "flags": {"catalytic": False}}
BAD = [
    ({"polarity": "maybe"}, "bad polarity"), ({"extra": 1}, "unknown keys extra"), ({"confidence": True}, "confidence must be a number"), ({"confidence": 5}, "out of range"),
    ({"flags": []}, "flags must be an object"), ({"flags": {"catalytic": "false"}}, "flags must be booleans"), ({"flags": {}}, "missing flags"), ({"quote": " "}, "missing quote"), ({"categories": []}, "needs a category"),
    ({"epistemic_impact": "zero_contribution", "flags": {"catalytic": True}}, "contradicts"), ({"locations": []}, "non-empty"), ({"locations": ["moon"]}, "unknown locations"), ({"tools": ["x" * 121]}, "bounded"),
    ({"tools": [1]}, "bounded"), ({"epistemic_impact": "cosmetic", "flags": {"catalytic": True}}, "at least supportive"), ({"polarity": "topic_only", "flags": {"catalytic": True}}, "requires author_use"),
]


def test_label_validation(spark):
    texts = [json.dumps(GOOD), *[json.dumps(GOOD | change) for change, _ in BAD], json.dumps({k: v for k, v in GOOD.items() if k != "quote"}), "no json", '{"polarity": "a", "polarity": "b"}', None]
    want = [None, *[w for _, w in BAD], "missing keys quote", "not an object", "not an object", "not an object"]
    df = spark.createDataFrame([(i, t, "so we  asked it") for i, t in enumerate(texts)], "i int, label_json string, snippet string")
    got = {r.i: r for r in B.validate_labels(df).collect()}
    for i, why in enumerate(want):
        assert got[i].reason is None if why is None else why in got[i].reason, (texts[i], got[i].reason)
    assert got[0].label.tools == ["GPT"] and got[0].label.quote_grounded and not got[0].cleared


def test_labels_without_use_are_cleared(spark):
    df = spark.createDataFrame([(json.dumps(GOOD | {"polarity": "topic_only"}), "x")], "label_json string, snippet string")
    got = B.validate_labels(df).first()
    assert got.cleared and got.label.categories == [] and got.label.epistemic_impact == "not_applicable"


def items(spark, *rows):
    schema = "id int, arxiv_id string, polarity string, impact string, tools array<string>, models array<string>, categories array<string>, location string, flags map<string,boolean>, quote_grounded int, render_status string, source_kind string"
    return spark.createDataFrame([(i, p, pol, imp, tools, [], [], loc, flags, g, st, k) for i, (p, pol, imp, tools, loc, flags, g, st, k) in enumerate(rows)], schema)


def test_roll_up(spark):
    df = items(
        spark,
        ("a", "topic_only", "not_applicable", [], None, {"method_component": True}, 0, "unchecked", "tex"),
        ("a", "author_use", "cosmetic", ["X"], "body", {"catalytic": False}, 1, "rendered", "tex"),
        ("a", "author_use", "result_bearing", ["Y"], None, {"catalytic": True}, 1, "unchecked", "meta:comments"),
        ("b", "author_use", "supportive", ["X"], "body", {}, 0, "rendered", "tex"),
        ("c", "false_positive", "not_applicable", [], None, {}, 0, "unchecked", "tex"),
    )
    got = {r.arxiv_id: r for r in B.roll_up(df, grounded=True, rendered=True).collect()}
    a = got["a"]
    assert (a.polarity, a.tools, a.impact, a.locations, a.ungated) == ("author_use", ["X", "Y"], "result_bearing", ["body", "unknown"], False)
    assert a.flags == {"catalytic": True, "method_component": True, "external_ai_artifact": False} and a.has_contributing_use
    assert (got["b"].polarity, got["b"].ungated, got["c"].polarity) == (None, True, "false_positive")
    assert {r.arxiv_id: r.polarity for r in B.roll_up(df).collect()}["b"] == "author_use"


def test_states_within_one_snippet_survive_the_roll_up(spark):
    rows = [(1, "p", "author_use", "supportive", True, None), (2, "p", "author_use", "cosmetic", False, None), (3, "q", "author_use", "result_bearing", None, True), (4, "q", "topic_only", "not_applicable", True, None)]
    told = spark.createDataFrame(rows, "id int, arxiv_id string, polarity string, impact string, has_explicit_zero_attempt boolean, has_undetermined_use boolean")
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    told = told.select("*", *[empty.alias(c) for c in ("tools", "models", "categories")], F.lit("body").alias("location"), F.expr("map('catalytic', false)").alias("flags"))
    got = {r.arxiv_id: (r.has_contributing_use, r.has_zero_contribution_attempt, r.has_undetermined_impact) for r in B.roll_up(told).collect()}
    assert got == {"p": (True, True, False), "q": (True, False, True)}


def test_bytes_other_than_the_ledgers_are_an_error(spark):
    items = spark.createDataFrame([("a", None, "1" * 64), ("b", None, "2" * 64), ("c", "OSError: x", "9" * 64), ("d", None, None)], "arxiv_id string, error string, read_sha256 string")
    hits = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("d", 4)], "arxiv_id string, id int")
    ledger = spark.createDataFrame([("a", "1" * 64), ("b", "3" * 64), ("c", "3" * 64), ("d", "4" * 64)], "arxiv_id string, sha256 string")
    told, left = S.checked_hashes(items, hits, ledger)
    assert {r.arxiv_id: r.error for r in told.collect()} == {"a": None, "b": f"HashMismatch: ledger {'3' * 12} != read {'2' * 12}", "c": "OSError: x", "d": None}
    assert sorted(r.id for r in left.collect()) == [1, 4]


def test_unresolved_papers_bound_the_rate(spark):
    papers = spark.createDataFrame([(str(k), "math.NT", "2024-01-05") for k in range(8)], "arxiv_id string, primary_category string, created string").withColumn("created", F.to_date("created"))
    scans = spark.createDataFrame([(str(k), "ok", 1, "explicit-v1") for k in range(6)], "arxiv_id string, status string, version int, version_basis string")
    hits = spark.createDataFrame([(str(k), "llm", "plain") for k in range(5)], "arxiv_id string, tier string, rule_class string")
    use = lambda k, status, grounded: (k, str(k), status, "author_use", "supportive", grounded)
    items = spark.createDataFrame([use(0, "ok", 1), use(1, "ok", 1), use(2, "ok", 0), use(3, "error:x", 1)], "id int, arxiv_id string, status string, polarity string, impact string, quote_grounded int")
    empty = F.expr("CAST(array() AS ARRAY<STRING>)")
    items = items.select("*", *[empty.alias(c) for c in ("tools", "models", "categories")], F.lit("body").alias("location"), F.expr("map('catalytic', false)").alias("flags"), F.lit("rendered").alias("render_status"), F.lit("tex").alias("source_kind"))
    files = spark.createDataFrame([("6", "ok")], "arxiv_id string, status string")
    told = release.paper_table(papers, scans, files, hits, items, "2024-01-01", "2024-02-01", grounded=True)
    got = release.unresolved(told).first().asDict()
    assert got == {"frame": 8, "positive": 2, "unresolved": 5, "not_scanned": 2, "pending": 1, "failed": 1, "unverified": 1, "lowest": 0.25, "highest": 0.875}
    cells = {(r.section, r.name): r.n for r in release.report(told, B.roll_up(items.where("status = 'ok'"), grounded=True)).collect()}
    assert cells["state", "scanned"] == 6 and cells["impact", "supportive"] == 2 and cells["category", "unknown"] == 2 and cells["polarity", "author_use"] == 2 and cells["location", "body"] == 2


def test_plants_and_blind_ids(spark):
    frame = spark.createDataFrame([(f"p{k}", "POS" if k % 2 else "NEG") for k in range(20)], "arxiv_id string, stratum string")
    orders = spark.createDataFrame([("a", f"p{k}", k) for k in range(20)] + [("b", f"p{k}", 19 - k) for k in range(20)], "reviewer string, arxiv_id string, place int")
    got = {r.arxiv_id for r in A.plant(frame, orders, 3, 5, 1).collect()}
    assert len(got) == 3 and all(int(p[1:]) % 2 and 5 <= int(p[1:]) < 15 for p in got)
    answers = spark.createDataFrame([("a", "i1", "yes"), ("a", "i2", "no")], "reviewer string, blind_id string, polarity string")
    keys = spark.createDataFrame([("a", "i1", "k1"), ("a", "i2", "k2"), ("a", "i3", "k3")], "reviewer string, blind_id string, key string")
    with pytest.raises(Exception, match="no answer to i3"):
        A.unblinded(answers, keys).collect()
    expected = spark.createDataFrame([("k1", "yes"), ("k2", "yes")], "key string, polarity string")
    assert {(r.axis, r.n, r.k) for r in A.axis_summary(A.unblinded(answers, keys.where("key <> 'k3'")), expected, "key", ["polarity"]).collect()} == {("polarity", 2, 1), ("all", 2, 1)}


def test_release_gates(spark):
    scan = spark.createDataFrame([("s", "tex", "complete", "abcdef1")], "run_id string, stage string, status string, code_commit string")
    label = lambda **x: spark.createDataFrame([({"run_id": "c", "scan_runs_json": '["s"]', "params_json": "{}", "status": "complete", "model": "m@1", "code_commit": "abcdef1", "backend": "api:x", "isolate": 1} | x)], "run_id string, scan_runs_json string, params_json string, status string, model string, code_commit string, backend string, isolate int")
    found = spark.createDataFrame([("s", "p", "ok")], "run_id string, arxiv_id string, status string")
    assert release.run_problems(scan, label(), found, "s", "c", freeze=True) == []
    for change, why in ((dict(status="running"), "status"), (dict(scan_runs_json='["t"]'), "belong"), (dict(model="m(unpinned)@x"), "pinned"), (dict(code_commit="abcdef1-dirty"), "commit"), (dict(isolate=0), "isolated"), (dict(backend="agent"), "backend"), (dict(params_json='{"scope": {"mode": "f"}}'), "scoped")):
        assert any(why in p for p in release.run_problems(scan, label(**change), found, "s", "c", freeze=True)), change
    assert "scan run" in release.run_problems(scan, label(), found, "missing", "c")[0]


def test_folding(spark):
    cells = spark.createDataFrame([("a", 9), ("b", 2), ("c", 1), ("d", 9)], "name string, n long")
    assert {(r.name, r.n) for r in R.fold_small(cells, "name", "n").collect()} == {("a", 9), ("d", 9), ("other (<3 each)", 3)}
    assert {(r.name, r.n) for r in R.fold_rest(cells, "name", "n", 1).collect()} == {("a", 9), ("Other", 12)}


def test_stream_sessions_and_first_versions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00"), (2, "2024-01-01 00:00:00")], "k int, t string").select("k", F.col("t").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in.parquet"))
    events = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in.parquet"))
    got = weekly.run_to_table(weekly.user_sessions(events, "k", "30 minutes"))
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
    assert weekly.run_to_table(weekly.first_versions(events, ["k"]), "append").count() == 2
    assert weekly.run_to_table(weekly.sliding_totals(events)).count() == 4
