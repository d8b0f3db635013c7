"""Runs that crash and come again, streams that stop and go on, comparisons against plain Python."""

import gzip
import itertools

import pytest
from pyspark.sql import functions as F

from metrascope.operators import comparison as C
from metrascope.operators.numbering import numbered
from metrascope.sources import pages as G
from metrascope.sources import sinks as K
from metrascope.streaming import upserts as U
from metrascope.workspace import Workspace


def test_a_cube_of_two_runs(spark):
    """Every count of every stratum, total and grand total, with papers of one run only, nulls and repeats."""
    one = [("a", "m1", "x", True), ("b", "m1", "y", False), ("c", "m2", "x", True), ("d", None, "x", None), ("a", "m1", "x", False), (None, "m1", "x", True)]
    two = [("b", "m9", "z", True), ("c", "m2", "x", True), ("d", "m2", None, False), ("e", None, "y", True), ("f", "m2", "y", False)]
    schema = "id string, month string, part string, use boolean"
    got = C.compare_cube(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), "id", "use", ["month", "part"]).collect()
    papers = {}  # id: month, part, in and positive in the first, in and positive in the second
    for side, rows in ((0, one), (1, two)):
        for k, month, part, use in rows:
            if k is not None:
                p = papers.setdefault(k, [None, None, [False, False], [False, False]])
                p[0], p[1] = p[0] or month, p[1] or part
                p[2 + side] = [True, p[2 + side][1] or bool(use)]
    want = {}
    for month, part, (x, a), (y, b) in papers.values():
        for m, q in itertools.product((month or "unknown", None), (part or "unknown", None)):
            cell = want.setdefault((m, q, 2 * (m is None) + (q is None)), dict.fromkeys(C.COUNTS, 0))
            for name, here in zip(C.COUNTS, (x and y, x and y and a, x and y and b, x and y and a and b, x and y and a and not b, x and y and b and not a, x and y and not a and not b, not y, not x, not y and a, not x and b), strict=True):
                cell[name] += bool(here)
    assert {(r["month"], r["part"], r["level"]): {c: r[c] for c in C.COUNTS} for r in got} == want
    total = next(r for r in got if r["level"] == 3)
    assert (total["common"], total["rate_one"], total["difference"]) == (3, pytest.approx(1 / 3), pytest.approx(-1 / 3))
    told = C.disagreements(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), "id", "use").collect()
    assert {r["id"]: r["outcome"] for r in told} == {"a": "missing_in_two", "b": "only_two", "e": "missing_in_one", "f": "missing_in_one"}
    none = spark.createDataFrame([], schema)
    assert [r["common"] for r in C.compare_cube(none, none, "id", "use", ["month"]).collect()] in ([], [None], [0])


@pytest.mark.parametrize("within", [[], ["g"]])
def test_numbers_in_order(spark, within):
    """Groups of one row and of nearly all, a null group, and no rows."""
    rows = spark.range(3000).select("id", F.when(F.col("id") % 50 == 0, F.col("id") % 7).when(F.col("id") % 3 > 0, F.lit(99)).alias("g"))
    work = Workspace(spark, "numbers")
    got = numbered(rows, [F.desc("id")], work, f"n{len(within)}", within).collect()
    held = {}
    for r in got:
        held.setdefault(r["g"] if within else 0, []).append((r["number"], r["id"]))
    assert len(got) == 3000
    for told in held.values():
        told.sort()
        assert [n for n, _ in told] == list(range(1, len(told) + 1)) and [i for _, i in told] == sorted((i for _, i in told), reverse=True)
    assert numbered(rows.where("id < 0"), ["id"], work, f"none{len(within)}", within).count() == 0


def test_a_run_counts_once_it_is_committed(spark, tmp_path):
    """A crash between tables and the run's row, a retry, another run, another version, another protocol, an empty table."""
    root = str(tmp_path / "store")
    hits = lambda *n: spark.createDataFrame([(f"p{i}", i) for i in n], "arxiv_id string, n int")
    row = lambda run: spark.createDataFrame([(run, "complete")], "run_id string, status string")
    assert K.committed_runs(spark, root).count() == 0
    K.write_run({"hits": hits(1, 2)}, root, "007", row("007"), "abc")
    hits(3, 4, 5).write.parquet(f"{root}/hits/run_id=crashed")  # its writer was lost before the row
    assert [r.arxiv_id for r in K.read_runs(spark, root, "hits").orderBy("n").collect()] == ["p1", "p2"]
    with pytest.raises(ValueError, match="not committed"):
        K.read_run(spark, root, "hits", "crashed")
    K.write_run({"hits": hits(3)}, root, "crashed", row("crashed"), "abc")
    K.write_run({"hits": hits()}, root, "empty", row("empty"), "other")
    assert [(r.run_id, r.n) for r in K.read_runs(spark, root, "hits").orderBy("n").collect()] == [("007", 1), ("007", 2), ("crashed", 3)]
    assert K.read_run(spark, root, "hits", "empty").count() == 0
    with pytest.raises(ValueError, match="is committed"):
        K.write_run({"hits": hits(9)}, root, "007", row("007"))
    with pytest.raises(ValueError, match="another protocol"):
        K.read_runs(spark, root, "hits", protocol_sha256="abc")
    assert K.read_run(spark, root, "hits", "007", protocol_sha256="abc").count() == 2
    with pytest.raises(ValueError, match="another version"):
        K.read_run(spark, root, "hits", "007", version=2)
    with pytest.raises(ValueError, match="run's id"):
        K.write_run({"hits": hits(1)}, root, "../x", row("../x"))


def test_an_upsert_twice_changes_nothing(spark, tmp_path):
    batches = [[(k, b * 10 + k % 3, f"b{b}") for k in range(b, b + 6)] for b in range(7)]
    held = U.UpsertTable(spark, str(tmp_path / "t"), ["k"], "at", merges=3)
    frame = lambda b: spark.createDataFrame(batches[b], "k int, at int, said string")
    with pytest.raises(ValueError, match="no batch"):
        held.read()
    want = {}
    for b in range(7):
        held.merge(frame(b), b)
        for k, at, said in batches[b]:
            if k not in want or at >= want[k][0]:
                want[k] = (at, said)
        if b in (2, 5):
            held.merge(frame(b), b)  # delivered again
        assert {r.k: (r.at, r.said) for r in held.read().collect()} == want
    held.merge(frame(6), 6)
    (tmp_path / "t/rows/batch=000000099").mkdir()  # a writer that was lost
    assert {r.k: (r.at, r.said) for r in held.read().collect()} == want
    assert held._held()[1] <= 4


def test_a_stream_of_upserts_goes_on(spark, tmp_path):
    source, keys = tmp_path / "in", ["k"]
    write = lambda name, rows: spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz, v int").coalesce(1).write.mode("append").parquet(str(source))
    from datetime import datetime

    from metrascope.streaming.weekly import event_stream

    held = U.UpsertTable(spark, str(tmp_path / "t"), keys, "v")
    for part in ([(1, 1, datetime(2024, 1, 1), 5), (1, 1, datetime(2024, 1, 1), 5), (2, 2, datetime(2024, 1, 1), 6)], [(3, 1, datetime(2024, 1, 2), 4), (2, 2, datetime(2024, 1, 1), 6), (4, 3, datetime(2024, 1, 2), 1)]):
        write("x", part)
        U.upsert_stream(event_stream(spark, str(source)), held, str(tmp_path / "c"), "ts", ["id"]).awaitTermination()
    assert sorted((r.k, r.v) for r in held.read().collect()) == [(1, 5), (2, 6), (3, 1)]
    assert held._told("rows") == [0, 1] or len(held._told("rows")) >= 2


def page(ids, token):
    records = "".join(f'<record><header{" status=" + chr(34) + "deleted" + chr(34) if i % 5 == 0 else ""}><identifier>{i}</identifier></header><metadata><a:arXivRaw xmlns:a="urn:a"><a:id>{i}</a:id></a:arXivRaw></metadata></record>' for i in ids)
    return f'<?xml version="1.0"?><OAI-PMH xmlns="urn:x"><ListRecords>{records}<resumptionToken cursor="0">{token}</resumptionToken></ListRecords></OAI-PMH>'.encode()


def test_a_harvest_goes_on_where_it_stopped(spark, tmp_path):
    """Pages that come later, gzipped or not, are read once; deleted records and half-written files are not."""
    from metrascope.sources.tables import papers_of, record_struct

    archive, out = tmp_path / "archive", str(tmp_path / "out")
    archive.mkdir()
    (archive / "page_0001.xml").write_bytes(page(range(1, 8), "t1"))
    (archive / "page_0002.xml.gz").write_bytes(gzip.compress(page(range(8, 12), "t2")))
    (archive / ".page_0003.tmp").write_bytes(b"half")

    def go():
        query = G.page_stream(spark, str(archive)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.parquet(out)
        return sorted((int(r.arxiv_id), r.page) for r in papers_of(rows.select("page", record_struct(F.col("record")).alias("r")).select("page", "r.*"), "page").collect())

    first = [(i, 1) for i in range(1, 8) if i % 5] + [(i, 2) for i in range(8, 12) if i % 5]
    assert go() == first and go() == first
    (archive / "page_0003.xml").write_bytes(page(range(12, 14), "t3"))
    (archive / "page_0004.xml").write_bytes(page(range(14, 17), ""))
    assert go() == first + [(i, 3) for i in (12, 13)] + [(i, 4) for i in (14, 16)]


def test_pages_of_another_harvest_are_refused(tmp_path):
    names = ["page_1.xml", "page_2.xml", "page_3.xml"]
    for name, token in zip(names, ("t1", "", "t3"), strict=True):
        (tmp_path / name).write_bytes(page([1], token))
    reader = G.PageReader(str(tmp_path))
    with pytest.raises(ValueError, match="last of its harvest"):
        reader.latestOffset()
    (tmp_path / "page_2.xml").write_bytes(page([1], "t2"))
    reader = G.PageReader(str(tmp_path))
    assert reader.latestOffset() == {"page": 3, "token": "t3"}
    assert [(p.number, p.inside.rpartition("/")[2]) for p in reader.partitions({"page": 1, "token": "t1"}, {"page": 3, "token": "t3"})] == [(2, "page_2.xml"), (3, "page_3.xml")]
    for start in ({"page": 1, "token": "t9"}, {"page": 2, "token": "t1"}):
        with pytest.raises(ValueError, match="not the archive"):
            reader.partitions(start, {"page": 3, "token": "t3"})


def test_papers_by_provider(spark):
    """A paper counts once for a provider; a name without a snippet, an empty name and a mere proof assistant do not make a model."""
    from metrascope.operators import providers as V

    labels = spark.createDataFrame([("a", ["ChatGPT", "GPT-4", "Lean"]), ("b", ["Claude Code", ""]), ("c", ["Lean"]), ("d", ["Gemini"]), ("e", []), ("f", None), ("b", ["Claude Code"])], "arxiv_id string, tools array<string>")
    snippets = spark.createDataFrame([("a", "used chatgpt and gpt-4"), ("a", "in LEAN"), ("b", "CLAUDE CODE wrote"), ("c", "lean"), ("d", None), ("z", "Gemini")], "arxiv_id string, snippet string")
    got = {(r.measure, r.name): r.papers for r in V.provider_papers(V.grounded_tools(labels, snippets)).collect()}
    assert got == {("named", None): 3, ("llm", None): 2, ("agentic", None): 1, ("other", None): 1, ("provider", "OpenAI"): 1, ("provider", "Anthropic"): 1, ("tool", "ChatGPT"): 1, ("tool", "GPT-4"): 1, ("tool", "Lean"): 2, ("tool", "Claude Code"): 1}


def test_series_are_written_in_order(spark, tmp_path):
    import json

    rates = spark.createDataFrame([("all", "2024-02", 0.5), ("all", "2024-01", None), ("x", "2024-01", 1.0)], "scope string, month string, rate double")
    K.write_series(rates, ["scope"], "month", str(tmp_path / "s"))
    lines = [json.loads(x) for f in (tmp_path / "s").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"scope": "all", "points": [{"month": "2024-01", "rate": None}, {"month": "2024-02", "rate": 0.5}]}, {"scope": "x", "points": [{"month": "2024-01", "rate": 1.0}]}]
