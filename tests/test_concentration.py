"""Hand-made authorship tables with known metrics."""

import pytest
from pyspark.sql import functions as F

from metrascope.operators import concentration as C
from metrascope.sources.sinks import write_metrics_csv
from metrascope.sources.tables import read_authorships

HEADER = "work_id,arxiv_id,publication_year,publication_month,author_id,primary_subfield,referenced_works_count,authorships_truncated,authorships_total,authorships_missing_id\n"
ROWS = [
    ("w1", 2018, "A", "NT", "10"), ("w2", 2019, "A", "NT", ""), ("w3", 2020, "A", "NT", "20"), ("w4", 2020, "A", "AG", "30"),
    ("w4", 2020, "B", "AG", "30"), ("w5", 2021, "A", "AG", "5"), ("w5", 2021, "B", "AG", "5"), ("w5", 2021, "C", "AG", "5"),
]


def table(tmp_path, rows=ROWS, extra=""):
    path = tmp_path / "authors.csv"
    path.write_text(HEADER + "".join(f"{w},x{w},{y},1,{a},{s},{r},no,{'3' if w == 'w5' else '2'},0\n" for w, y, a, s, r in rows) + extra)
    return str(path)


def test_a_year_by_hand(spark, tmp_path):
    papers = C.rebuild_papers(read_authorships(spark, table(tmp_path)))
    got = C.annual_metrics(papers, 2020, 2020, minimum_lookback=2, subfields=False).first()
    assert (got.n_papers, got.n_active_authors, got.fractional_output_per_author) == (2, 2, 1.0)
    assert (got.new_author_share, got.solo_paper_share, got.mean_team_size, got.median_team_size) == (0.5, 0.5, 1.5, 1.5)
    assert got.top_10pct_fractional_share == pytest.approx(0.75)
    assert got.gini_fractional_output == pytest.approx(0.25)
    assert (got.mean_referenced_works, got.reference_coverage_share, got.complete_authorship_paper_share) == (25.0, 1.0, 1.0)
    assert got.left_censored_author_share == 0.5


def test_scopes_and_file(spark, tmp_path):
    papers = C.rebuild_papers(read_authorships(spark, table(tmp_path)))
    metrics = C.annual_metrics(papers, 2020, 2021, minimum_lookback=2)
    assert {(r.year, r.scope) for r in metrics.collect()} == {(2020, "all"), (2020, "subfield:AG"), (2020, "subfield:NT"), (2021, "all"), (2021, "subfield:AG")}
    write_metrics_csv(metrics, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == C.FIELDS


def test_duplicates_and_completeness(spark, tmp_path):
    extra = "w6,xw6,2020,1,A,NT,1,yes,2,1\nw6,xw6,2020,1,A,NT,1,no,2,1\n"
    papers = C.rebuild_papers(read_authorships(spark, table(tmp_path, extra=extra)))
    told = C.diagnostics(papers).first()
    assert (told.input_rows, told.duplicate_authorship_rows, told.papers_with_truncated_authorships, told.papers_with_missing_author_ids) == (10, 1, 1, 1)
    got = C.annual_metrics(papers, 2020, 2020, minimum_lookback=2, subfields=False, require_complete=True).first()
    assert (got.n_papers_frame, got.n_papers) == (3, 2)
    assert got.complete_authorship_paper_share == pytest.approx(2 / 3)


def test_inequality_of_known_values(spark):
    def of(*values):
        df = spark.createDataFrame([(1, float(v)) for v in values], "g int, v double")
        return C.inequality(df, ["g"], {"v": ("gini", {"top": 0.10})}).first()

    assert of(1, 1).gini == 0
    assert of(0, 2).gini == pytest.approx(0.5)
    assert of(1.5, 0.5).top == pytest.approx(0.75)
    assert of(0, 0).gini == 0


@pytest.mark.parametrize(("bad", "why"), [("w7,x,1850,1,A,NT,,no,,\n", "out of range"), ("w7,x,2020,13,A,NT,,no,,\n", "month"), ("w7,x,2020,1,,NT,,no,,\n", "required"), ("w7,x,2020,1,A,NT,two,no,,\n", "integer"), ("w7,x,2020,1,A,NT,,no,1,2\n", "exceed")])
def test_refuses_bad_rows(spark, tmp_path, bad, why):
    with pytest.raises(Exception, match=why):
        read_authorships(spark, table(tmp_path, extra=bad)).collect()


def test_refuses_inconsistent_works_and_lost_columns(spark, tmp_path):
    with pytest.raises(Exception, match="inconsistent metadata for work w1"):
        C.rebuild_papers(read_authorships(spark, table(tmp_path, extra="w1,xw1,2019,1,B,NT,10,no,2,0\n"))).collect()
    (tmp_path / "short.csv").write_text("work_id,arxiv_id\n1,2\n")
    with pytest.raises(ValueError, match="author_id"):
        read_authorships(spark, str(tmp_path / "short.csv"))


def test_lookback(spark, tmp_path):
    papers = C.rebuild_papers(read_authorships(spark, table(tmp_path)))
    with pytest.raises(ValueError, match="lookback"):
        C.annual_metrics(papers, 2020, 2020, minimum_lookback=5)


def test_index_starts_at_the_first_value_that_counts(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, 4), (4, 6)], "year int, v int")
    assert [r[0] for r in df.orderBy("year").select(C.indexed(df, "year", "v")).collect()] == [None, 0.0, 100.0, 150.0]
    assert df.select(F.lit(1)).count() == 4
