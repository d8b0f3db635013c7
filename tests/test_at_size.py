"""What larger tables bring out: ids with more digits, work that grows faster than its input."""

import pytest
from pyspark.sql import functions as F

from metrascope import queries


def against_sql(spark, path, name):
    """A registered query over the tables of a folder, and its SQL over the same, as sorted rows."""
    import duckdb

    db = duckdb.connect()
    for x in sorted(path.glob("*.parquet")):
        db.execute(f"CREATE VIEW {x.stem} AS SELECT * FROM '{x}/*.parquet'")
    told = db.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in told.description]
    got = queries.QUERIES[name](spark, str(path)).select(*names)
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, told.fetchall()))


def test_a_list_of_documents_with_ids_of_any_length(spark, tmp_path):
    """Ids of six to nine digits, a month's hundred-thousandth, and a document told twice."""
    ids = [*range(0, 200), *range(99_990, 100_100), *range(1_199_990, 1_200_100), *range(91_199_990, 91_200_050), *range(119_999_900, 120_000_000), 7_000_001, 7_000_001]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(str(tmp_path / "documents.parquet"))
    got, want = against_sql(spark, tmp_path, "list_reconciliation")
    assert got == want
    spark.createDataFrame([(120_000_000 + i,) for i in range(60)], "doc_id long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(Exception, match="no ids"):
        queries.QUERIES["list_reconciliation"](spark, str(tmp_path)).collect()


def test_a_campaign_asks_the_state_store_twice_a_batch():
    """Not once or more for each event; every access is a message to another process."""
    from pyspark.sql import Row

    from metrascope.streaming import campaigns as L

    class Store:
        def __init__(self):
            self.held, self.calls = None, 0

        def getValueState(self, *_):
            return self

        def getMapState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.calls += 1
            self.held = value

    store, ledger, told = Store(), L.Campaigns(), []
    ledger.init(store)
    row = Row(*[c.split()[0] for c in L.EVENT.split(", ")])
    kinds = ("reserved", "settled", "reserved", "amended")
    for batch in range(2):
        events = [row("c", 0, "created", None, 1e6)] * (batch == 0) + [row("c", 1 + 200 * batch + n, kinds[n % 4], f"r{n % 8 // 2}", 2.0) for n in range(200)]
        told += ledger.handleInputRows(("c",), iter(reversed(events)), None)
    assert store.calls == 4 and len(told) == 401 and [r.seq for r in told] == sorted(r.seq for r in told)
    assert store.held[4] == {"r1": 2.0, "r3": 2.0} and told[-1].open == 2 and sum(not r.taken for r in told) == told[-1].seq // 4 - 2


def test_outcomes_of_campaigns_from_several_files_a_part(spark, sf, agree, monkeypatch):
    from metrascope.queries import runs

    monkeypatch.setattr(runs, "EVENTS_A_FILE", 100, raising=False)
    agree(queries.QUERIES["campaign_outcomes"], queries.ORACLE_SQL["campaign_outcomes"])


def test_lines_are_hashed_by_tasks_that_follow_each_other(spark, monkeypatch):
    """The same digest however few bytes a task takes; equal lines, blocks of one range, one line, none, and an empty line."""
    import hashlib

    from metrascope.operators import selection as S

    asked = []
    own = getattr(S, "_digested", None)
    monkeypatch.setattr(S, "_digested", lambda held, chunk, *rest: (asked.append(chunk), own(held, chunk, *rest))[1], raising=False)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        for lines, most in (([f"é{i % 700}:{i}" for i in range(3000)], 5000), (["same"] * 3000, 2000), (["", "b"], 1), (["only"], 1), ([""], 1), ([], 1)):
            monkeypatch.setattr(S, "HASHED", most, raising=False)
            asked.clear()
            got = S.lines_hash(spark.createDataFrame([(x,) for x in lines], "line string"), F.col("line")).collect()
            assert [tuple(r) for r in got] == [(len(lines), hashlib.sha256("\n".join(sorted(lines, key=str.encode)).encode()).hexdigest())]
            assert len(asked) >= min(len(lines) // 400, 6) and (lines == [] or asked)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_the_lexicon_is_scanned_by_many_tasks(spark, sf, monkeypatch):
    """Some for each core, so that no task has a twelfth of all texts; a dotted capital I counts as an i."""
    from metrascope.operators import lexicon as L
    from metrascope.queries import corpus

    asked = []
    monkeypatch.setattr(corpus.L, "scan", lambda docs, *rest: (asked.append(docs.rdd.getNumPartitions()), docs.withColumn("context", F.lit(1)))[1])
    corpus.lexicon_scan(spark, sf)
    assert asked[0] >= 8 * spark.sparkContext.defaultParallelism
    monkeypatch.undo()
    got = L.scan(spark.createDataFrame([(1, "MİSTRAL"), (2, "Mistral, Claude Bernard"), (3, "the Mıstral gap")], "id int, text string"), ["id"]).collect()
    assert sorted((r.id, r.term, r.rule_class) for r in got) == [(1, "Mistral", "plain"), (2, "Claude", "known_fp"), (2, "Mistral", "plain"), (3, "Mistral", "plain")]


def test_a_round_of_requests_keeps_texts_once(spark):
    """Batches that are halved to the end write each text once a round and once before, and no prompts."""
    import random
    from pathlib import Path

    from metrascope.operators import labelling as B
    from metrascope.workspace import Workspace

    def call(prompt):
        if prompt.count("SNIPPET ") > 1:
            raise RuntimeError("truncated at the limit of output")
        return B.RuleLabeller([])(prompt)

    draw, work = random.Random(3), Workspace(spark, "once")
    texts = ["".join(chr(draw.randrange(0x4E00, 0x9E00)) for _ in range(30_000)) for _ in range(8)]
    told, records = B.label_batches(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), call, work, "id", "text", None, 8)
    assert {(r.key, len(r.split_path)) for r in told.collect()} == {(str(i), 7) for i in range(8)} and records.count() == 15
    path = Path(work.path.removeprefix("file:"))
    written = sum(x.stat().st_size for x in path.rglob("*.parquet"))
    assert written < 6 * sum(len(x.encode()) for x in texts)


def test_many_pages_of_an_archive_are_read_by_few_tasks(tmp_path):
    """A thousand pages are all read, in order and once, by runs of pages; an archive that goes on is read from there."""
    from metrascope.sources import pages as G

    for k in range(1000):
        (tmp_path / f"page_{k:04}.xml").write_text(f"<x><record><id>{k}</id></record><record><id>{k}b</id></record><resumptionToken>{'t' * (k < 999)}{k * (k < 999) or ''}</resumptionToken></x>")
    reader = G.PageReader(str(tmp_path))
    end = reader.latestOffset()
    for first in (0, 501):
        start = {"page": first, "token": reader.tokens[first - 1] if first else ""}
        parts = reader.partitions(start, end)
        assert len(parts) <= 64
        assert [row[:2] for p in parts for row in reader.read(p)] == [(k + 1, place) for k in range(first, 1000) for place in (0, 1)]
    assert reader.partitions(end, end) == []


def test_an_as_of_join_makes_its_rows_once(spark):
    from metrascope.operators.asof import last_before
    from metrascope.workspace import Workspace

    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(x):
        made.add(1)
        return x

    points = spark.range(200).select(F.lit(1).alias("k"), told("id").alias("at"))
    marks = spark.range(0, 200, 50).select(F.lit(1).alias("k"), F.col("id").alias("mark"), F.col("id").alias("v"))
    got = last_before(points, marks, ["k"], "at", "mark", ["v"], Workspace(spark, "asof-once"), "t").collect()
    assert made.value == 200 and {(r["at"], r["v"]) for r in got} == {(i, i // 50 * 50) for i in range(200)}
