"""Readers and writers on files made here."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from metrascope.sources import archives as A
from metrascope.sources import sinks as K
from metrascope.sources import tables as T

TEX = "\\documentclass{article}\\begin{document}We used ChatGPT\\end{document}"


def tar(*members, mode="w:gz"):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, body in members:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            archive.addfile(info, io.BytesIO(body))
    return out.getvalue()


@pytest.mark.parametrize(
    ("data", "told"),
    [
        (TEX.encode(), [("main.tex", "tex", None)]),
        (b"%PDF-1.4", [(None, None, "unknown-format:not-tex")]),
        (gzip.compress(TEX.encode()), [("main.tex", "tex", None)]),
        (gzip.compress(b"plain words"), [(None, None, "unknown-format:single-gz")]),
        (gzip.compress(b"\\begin" + b"x" * 2000), [(None, None, "skipped-budget:single-gz:>1000")]),
        (tar(("a.tex", b"x"), ("b/chatgpt_log.json", b"{}"), ("c.png", b"y"), ("d.bbl", b"\\begin{x}"), ("e.bbl", b"none")), [("a.tex", "tex", None), ("b/chatgpt_log.json", "ancillary", None), ("d.bbl", "tex", None)]),
        (tar(("big.tex", b"x" * 600), ("small.tex", b"y" * 400), ("more.tex", b"z" * 450), ("last.tex", b"w" * 300), mode="w"), [("big.tex", None, "skipped-large:big.tex:600"), ("small.tex", "tex", None), ("more.tex", "tex", None), ("last.tex", None, "skipped-budget:last.tex:300")]),
    ],
)
def test_expand(data, told):
    assert [(m, k, n) for m, k, _, n in A.expand(data, total_bytes=1000, member_bytes=500)] == told


def test_archives_and_status(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tar.gz").write_bytes(tar(("a.tex", b"caf\xe9")))
    (tmp_path / "in/b.gz").write_bytes(b"\x1f\x8bbroken")
    rows = A.read_archives(spark, str(tmp_path / "in"))
    got = {r.path.rsplit("/", 1)[1]: (r.member, r.text, r.note) for r in rows.collect()}
    assert got["a.tar.gz"] == ("a.tex", "café", None) and got["b.gz"][2].startswith("error:")
    status = spark.createDataFrame([("OSError: x", []), (None, ["unknown-format:y"]), (None, ["skipped-large:a:1"]), (None, ["skipped:pdf-tar-member", "unknown-format"]), (None, [])], "e string, n array<string>")
    assert [r[0] for r in status.select(A.item_status(F.col("e"), F.col("n"))).collect()] == ["error:OSError", "error:UnknownFormat", "incomplete:members-skipped", "skipped:pdf-tar-member", "ok"]


def test_members_by_reference(spark, tmp_path):
    (tmp_path / "in/2024").mkdir(parents=True)
    (tmp_path / "in/2024/jan.tar").write_bytes(tar(("a/x.tex", b"one"), ("b.tex", b"two"), mode="w"))
    (tmp_path / "in/plain.gz").write_bytes(b"three")
    refs = ["2024/jan.tar::a/x.tex", "2024/jan.tar::none", "plain.gz", "gone.gz", "plain.gz"]
    got = A.read_members(spark, str(tmp_path / "in"), spark.createDataFrame([(r,) for r in refs], "ref string"))
    assert {r.ref: r.content and bytes(r.content) for r in got.collect()} == {"2024/jan.tar::a/x.tex": b"one", "2024/jan.tar::none": None, "plain.gz": b"three", "gone.gz": None}


def test_contexts_are_cut_again_where_hits_were(spark, tmp_path):
    (tmp_path / "a.tar.gz").write_bytes(tar(("a.tex", b"% gone\nUniversit\\'e~Claude wrote")))
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.tar.gz")).select("path", "content")
    path = files.first().path
    hits = spark.createDataFrame([(path, "a.tex", 12, "Claude"), (path, "a.tex", 3, "Claude"), (path, "b.tex", 0, "x")], "path string, member string, offset int, matched string")
    assert sorted((r.offset, r.context, r.stands) for r in A.re_extract(files, hits, 7).where("context IS NOT NULL").collect()) == [(3, "\nUniversit"[:10], False), (12, "ersite Claude w"[:14], True)]


def test_tar_ledger(spark, tmp_path):
    (tmp_path / "x.tar").write_bytes(tar(("a", b"%PDF"), ("b", b"zz"), ("a", b"%PDF-2"), mode="w"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "x.tar"))
    assert [(r.member, r.size, r.format, r.n_seen) for r in A.tar_ledger(files).collect()] == [("a", 4, "pdf", 0), ("b", 2, "other", 0), ("a", 6, "pdf", 1)]


PAGE = """<?xml version="1.0"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>
<record><header status="deleted"><identifier>gone</identifier></header></record>
<record><header><identifier>x</identifier><datestamp>2024-02-01</datestamp></header><metadata><arXivRaw xmlns="http://arxiv.org/OAI/arXivRaw/">
<id>0704.0001</id><submitter>Somebody</submitter><version version="v2"><date>Tue, 3 Apr 2007 10:00:00 GMT</date><size>2kb</size></version>
<version version="v1"><date>Mon, 2 Apr 2007 19:18:42 GMT</date><size>1kb</size></version>
<title>A   title
 here</title><authors>A. B.</authors><categories>math.NT math.CO</categories><abstract> Text </abstract></arXivRaw></metadata></record>
</ListRecords></OAI-PMH>"""


def test_metadata_pages(spark, tmp_path):
    (tmp_path / "p/2024").mkdir(parents=True)
    (tmp_path / "p/2024/page_1.xml.gz").write_bytes(gzip.compress(PAGE.encode()))
    (got,) = T.read_metadata_pages(spark, str(tmp_path / "p")).collect()
    assert (got.arxiv_id, got.title, got.abstract, got.submitter, got.comments) == ("0704.0001", "A title here", "Text", None, None)
    assert (got.primary_category, got.created, got.latest_version, got.oai_datestamp) == ("math.NT", "2007-04-02", 2, "2024-02-01")
    assert [v.version for v in got.versions] == [1, 2]


def test_lists(spark):
    lines = ["| **[One](https://arxiv.org/abs/2401.00001)** | NT, CO |", "| **[Two](http://x.org)** | AG |", "text", "| **[Three](https://arxiv.org/pdf/2402.00003)** | NT |", "| **[Four](https://arxiv.org/abs/2401.00004)** | NT |", "| **[Five](https://arxiv.org/abs/2401.00005)** | NT |"]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    with pytest.raises(ValueError, match="has 5 entries"):
        T.parse_list(rows)
    entries = T.parse_list(rows, least=5)
    assert entries.count() == 5 and entries.where("title = 'One'").first().subjects == ["NT", "CO"]
    papers = spark.createDataFrame([("2401.00001", "math.NT"), ("2401.00004", "cs.AI")], "arxiv_id string, primary_category string")
    flagged = spark.createDataFrame([("2401.00001",)], "arxiv_id string")
    got = {r.title: r.bucket for r in T.list_buckets(entries, papers, flagged, ["2401"]).collect()}
    assert got == {"One": "in_frame_flagged", "Two": "no_arxiv_id", "Three": "out_of_frame_window", "Four": "out_of_frame_category", "Five": "not_in_db"}


def test_ids_ledgers_and_verdicts(spark, tmp_path):
    (tmp_path / "ids").write_text("a\nb\n\na \n")
    assert sorted(r.arxiv_id for r in T.read_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]
    (tmp_path / "l.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in T.read_ledger(spark, str(tmp_path / "l.jsonl"), "id int").collect()) == [1, 2]
    (tmp_path / "v.json").write_text(json.dumps({"project": "p", "reviewer": "r", "codebook_version": "1", "items": [{"arxiv_id": "a", "verdict": "yes"}, {"arxiv_id": "b", "verdict": "no"}]}, indent=1))
    assert [(r.arxiv_id, r.verdict) for r in T.read_verdicts(spark, str(tmp_path / "v.json")).orderBy("place").collect()] == [("a", "yes"), ("b", "no")]


def test_sinks(spark, tmp_path):
    hits = spark.createDataFrame([("p", 1)], "arxiv_id string, n int")
    for run in ("one", "two"):
        K.write_run({"hits": hits}, str(tmp_path / "store"), run, spark.createDataFrame([(run, "complete", 1)], "run_id string, status string, at int"))
    own = K.read_run(spark, str(tmp_path / "store"), "hits", "two")
    assert own.count() == 1 and "PartitionFilters: [isnotnull(run_id" in own._jdf.queryExecution().toString()
    events = spark.createDataFrame([("one", "running", 1), ("one", "complete", 2)], "run_id string, status string, at int")
    assert [r.status for r in K.current_runs(events).collect()] == ["complete"]
    assert sorted(tuple(r) for r in K.upsert(hits, spark.createDataFrame([("p", 2), ("q", 3)], "arxiv_id string, n int"), ["arxiv_id"]).collect()) == [("p", 2), ("q", 3)]
    told = K.write_manifest(str(tmp_path / "m.json"), hits.agg(F.count(F.lit(1)).alias("rows")), release="r1")
    assert told == {"release": "r1", "rows": 1} == json.loads((tmp_path / "m.json").read_text())
    assert len(K.file_sha256(spark, str(tmp_path / "m.json")).first().sha256) == 64


def test_reports_and_lines(spark, tmp_path):
    cells = spark.createDataFrame([("state", "scanned", 3), ("state", "unfetched", 1), ("month", "2024-01", 4)], "section string, name string, n long")
    K.write_report(cells, str(tmp_path / "r"))
    lines = [json.loads(x) for f in (tmp_path / "r").glob("part-*") for x in f.read_text().splitlines()]
    assert lines == [{"section": "month", "counts": {"2024-01": 4}}, {"section": "state", "counts": {"scanned": 3, "unfetched": 1}}]
    for _ in range(2):
        K.append_lines(cells, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6


def test_chart():
    svg = K.svg_lines("t", {"a": [(1, 1.0), (2, None), (3, 2.0)], "b": [(1, 0.0)]})
    assert svg.count("<polyline") == 3 and K.svg_lines("t", {}).startswith("<svg")
