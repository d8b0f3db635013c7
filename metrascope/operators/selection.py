"""Selections, reconciliations and coverage by semi, anti and outer joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import SHA256
from ..workspace import Workspace
from .sessions import pick_first

#: Coverage states in their order of precedence.
STATES = ("scanned", "scan_error", "fetch_failed", "fetched_not_in_run", "unfetched")
#: Bytes of sorted lines that one task digests, about.
HASHED = 256 << 20


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others.select(*keys).distinct(), keys, "left_anti")


def among(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others.select(*keys).distinct(), keys, "left_semi")


def todo(papers: DataFrame, files: DataFrame, key: str, residual: Column) -> DataFrame:
    """Papers without a file that meets the residual condition."""
    return without(papers, files.where(residual), [key])


def queue(rows: DataFrame, preferred: DataFrame, key: str, order: Column, limit: int, only: bool = False) -> DataFrame:
    """The first ``limit`` of ``rows`` with place, from 1: those among ``preferred`` first (with ``only``, no others), each part in the given order."""
    told = rows.join(preferred.select(key).distinct().withColumn("_first", F.lit(True)), key, "left_semi" if only else "left")
    sort = [order, F.col(key)] if only else [F.col("_first").isNull(), order, F.col(key)]
    # The first rows are found by all tasks, and only these are numbered.
    return told.orderBy(*sort).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*sort))).select(*rows.columns, "place")


def to_render(items: DataFrame, polarities: list[str], redo: bool = False) -> DataFrame:
    """Valid items with a quote whose rendering is to be checked; without ``redo`` only those unchecked or failed for want of a PDF."""
    own = (F.col("status") == "ok") & F.col("polarity").isin(*polarities) & (F.coalesce("quote", F.lit("")) != "")
    return items.where(own if redo else own & F.col("render_status").isin("unchecked", "pdf_error"))


def ingested(verdicts: DataFrame, assigned: DataFrame, existing: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """``verdicts`` with outcome: ``rejected`` if not in the drawn sample, ``duplicate`` if there before, else ``new``."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    told = verdicts.join(mark(assigned, "_drawn"), key, "left").join(mark(existing, "_there"), key, "left")
    outcome = F.when(F.col("_drawn").isNull(), "rejected").when(F.col("_there"), "duplicate").otherwise("new")
    return told.select(*verdicts.columns, outcome.alias("outcome"))


def hit_summary(hits: DataFrame, relevant: Column, key: str, order: Column) -> DataFrame:
    """One row for each paper with hits (status, term, source, snippet): counts, sorted sets, and the snippet of the first relevant hit, or of the first."""
    distinct = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ").alias(f"{c}es" if c.endswith("s") else f"{c}s")
    own = F.count_if(relevant)
    told = hits.groupBy(key).agg(F.count(F.lit(1)).alias("hit_count"), own.alias("relevant_hit_count"), *[distinct(c) for c in ("status", "term", "source")], F.min_by("snippet", F.struct((~relevant).alias("r"), order.alias("o"))).alias("representative_snippet"))
    return told.withColumn("auto_class", F.when(F.col("relevant_hit_count") > 0, "probable_author_ai_use").otherwise("possible_only"))


def by_version_count(versions: DataFrame, key: str, several: bool) -> DataFrame:
    """Keys with more than one version, or with exactly one."""
    n = F.count(F.lit(1))
    return versions.groupBy(key).agg(n.alias("_n")).where((F.col("_n") > 1) if several else (F.col("_n") == 1)).select(key)


def pick_artifacts(artifacts: DataFrame, versions: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """The first-version artifact of each paper, and the basis of that claim.

    An artifact of version 1 is explicit; one without a version counts for
    papers with a single version. Sources go before PDFs, explicit before
    inferred, then the smallest id.
    """
    single = by_version_count(versions, key, False).withColumn("_single", F.lit(True))
    told = artifacts.join(single, key, "left")
    explicit, inferred = F.col("version") == 1, F.col("version").isNull() & F.col("_single")
    told = told.where(F.coalesce(explicit | inferred, F.lit(False))).withColumn("basis", F.when(explicit, "explicit-v1").otherwise("inferred-single-version"))
    return pick_first(told, [key], F.col("kind") == "pdf", F.col("basis") != "explicit-v1", "id").drop("_single")


def reconcile(expected: DataFrame, found: DataFrame, key: str, group: str, known: DataFrame) -> DataFrame:
    """(problem, key) of what one side has and the other has not, or has twice or elsewhere."""
    have = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(group).alias("_found"))
    want = expected.select(key, F.col(group).alias("_want")).dropDuplicates([key])
    met = want.join(have, key, "full_outer").join(known.select(key, F.lit(True).alias("_known")).dropDuplicates([key]), key, "left")
    told = F.array_compact(F.array(
        F.when(F.col("_n").isNull(), F.lit("missing")), F.when(F.col("_want").isNull(), F.lit("extra")),
        F.when(F.col("_n") > 1, F.lit("duplicate")), F.when(F.col("_want") != F.col("_found"), F.lit("wrong_group")),
        F.when(F.col("_known").isNull() & F.col("_n").isNotNull(), F.lit("unknown"))))
    return met.select(F.explode(told).alias("problem"), key)


def problem_report(problems: DataFrame, key: str, sample: int = 50) -> DataFrame:
    """(problem, n, sample): counts and the first ``sample`` keys of each problem."""
    n = problems.groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
    first = pick_first(problems, ["problem"], key, k=sample).groupBy("problem").agg(F.sort_array(F.collect_list(key)).alias("sample"))
    return n.join(first, "problem")


def coverage(frame: DataFrame, items: DataFrame, files: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """Exactly one state of ``STATES`` for each paper of the frame.

    ``items``: key, status of the run's scan; ``files``: key, status of fetches,
    of which any that is ok suffices.
    """
    scans = items.groupBy(key).agg(F.bool_or(F.col("status") == "ok").alias("_ok"))
    fetched = files.groupBy(key).agg(F.bool_or(F.col("status").startswith("ok")).alias("_got"))
    met = frame.join(scans, key, "left").join(fetched, key, "left")
    state = F.when(F.col("_ok"), STATES[0]).when(F.col("_ok").isNotNull(), STATES[1]).when(F.col("_got").isNull(), STATES[4])
    return met.withColumn("state", state.when(F.col("_got"), STATES[3]).otherwise(STATES[2])).drop("_ok", "_got")


def checked_hashes(items: DataFrame, hits: DataFrame, ledger: DataFrame, key: str = "arxiv_id") -> tuple[DataFrame, DataFrame]:
    """(items, hits) of a scan held against a ledger (key, sha256): bytes other than the ledger's are an error, and their hits do not count.

    ``items``: key, error, read_sha256. Items that failed before keep their error.
    """
    told = items.join(ledger.select(F.col(key).alias("_key"), F.col("sha256").alias("_want")), F.col(key) == F.col("_key"), "left")
    differs = F.coalesce(F.col("error").isNull() & (F.col("_want") != F.col("read_sha256")), F.lit(False))
    why = F.concat(F.lit("HashMismatch: ledger "), F.left("_want", F.lit(12)), F.lit(" != read "), F.left("read_sha256", F.lit(12)))
    told = told.withColumn("error", F.when(differs, why).otherwise(F.col("error"))).select(*items.columns)
    return told, without(hits, told.where(F.col("error").startswith("HashMismatch")), [key])


def version_stratum(version: Column, basis: Column) -> Column:
    """unknown, later, v1_inferred or v1; an unknown version is never taken for the first."""
    return F.when(version.isNull(), "unknown").when(version != 1, "later").when(basis == "inferred-single-version", "v1_inferred").otherwise("v1")


def compare_runs(one: DataFrame, two: DataFrame, key: str, positive: str) -> DataFrame:
    """(common, positive_one, positive_two, both, only_one, only_two) of two runs over common papers."""
    a = one.select(key, F.col(positive).alias("_a"))
    met = a.join(two.select(key, F.col(positive).alias("_b")), key)
    return met.agg(F.count(F.lit(1)).alias("common"), F.count_if("_a").alias("positive_one"), F.count_if("_b").alias("positive_two"), F.count_if(F.col("_a") & F.col("_b")).alias("both"), F.count_if(F.col("_a") & ~F.col("_b")).alias("only_one"), F.count_if(~F.col("_a") & F.col("_b")).alias("only_two"))


def lines_hash(rows: DataFrame, line: Column) -> DataFrame:
    """(n, sha256) of the sorted lines.

    All tasks sort their ranges of lines and write them as blocks. A hash has to
    meet these in order, so tasks follow each other: each digests about
    ``HASHED`` bytes and hands the state of the hash on to the next.
    """
    schema = "part int, place int, n long, bytes long, lines binary"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                lines = "".join(x + "\n" for x in batch.column(0).to_pylist()).encode()
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([batch.num_rows], pa.int64()), pa.array([len(lines)], pa.int64()), pa.array([lines], pa.binary())], ["part", "place", "n", "bytes", "lines"])
                place += 1

    work = Workspace(rows.sparkSession, "lines")
    held = work.save(rows.select(line.alias("line")).orderBy("line").mapInArrow(blocks, schema), "blocks")
    # A row for each range of the sort.
    parts = held.groupBy("part").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("blocks")).orderBy("part").collect()
    last, state = sum(r["bytes"] for r in parts) - 1, SHA256.start()
    for chunk in _chunks([(r["part"], r["blocks"], r["bytes"]) for r in parts], HASHED):
        state = _digested(held, chunk, state, last)
    return rows.sparkSession.createDataFrame([(sum(r["n"] for r in parts), SHA256.end(state))], "n long, sha256 string").coalesce(1)


def _chunks(parts: list[tuple[int, int, int]], most: int) -> Iterator[list[tuple[int, int, int]]]:
    """Runs of (part, first block, block after the last) of about ``most`` bytes, from (part, blocks, bytes) in order; a part of more is cut between its blocks."""
    run, size = [], 0
    for part, n, total in parts:
        each = max(1, n * most // max(total, 1))
        for first in range(0, n, each):
            upto = min(first + each, n)
            here = total * (upto - first) // n
            if run and size + here > most:
                yield run
                run, size = [], 0
            run, size = [*run, (part, first, upto)], size + here
    if run:
        yield run


def _digested(held: DataFrame, chunk: list[tuple[int, int, int]], state: bytes, last: int) -> bytes:
    """The state of the hash after the blocks of a chunk; the last line's end, at byte ``last`` of all, does not count."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = SHA256.go_on(state)
        for batch in batches:
            for lines in batch.column(0):
                lines = lines.as_py()
                told.update(lines[: last - told.size] if told.size + len(lines) > last else lines)
        yield pa.record_batch([pa.array([told.state()], pa.binary())], ["state"])

    inside = reduce(Column.__or__, [(F.col("part") == part) & (F.col("place") >= first) & (F.col("place") < upto) for part, first, upto in chunk])
    rows = held.where(inside & F.col("part").between(chunk[0][0], chunk[-1][0])).coalesce(1).sortWithinPartitions("part", "place").select("lines")
    return bytes(rows.mapInArrow(digest, "state binary").first()[0])


def membership_hash(rows: DataFrame, key: Column, version: Column) -> DataFrame:
    """(n, membership_sha256) of the sorted ``key:version`` lines; an unknown version is written as None."""
    line = F.concat_ws(":", key.cast("string"), F.coalesce(version.cast("string"), F.lit("None")))
    return lines_hash(rows, line).withColumnRenamed("sha256", "membership_sha256")


def selection_record(jobs: DataFrame, key: str = "arxiv_id", fields: Sequence[str] = ("version", "basis", "kind", "path"), basis: str = "basis") -> DataFrame:
    """(n, basis_counts, selection_sha256): what a scan selected and why, as a hash of its sorted lines of all fields, and the papers by basis; unknown fields are written as None."""
    line = F.concat_ws(":", F.col(key).cast("string"), *[F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields])
    counts = jobs.groupBy(F.coalesce(F.col(basis).cast("string"), F.lit("None")).alias("b")).agg(F.count_distinct(key).alias("n"))
    counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("basis_counts"))  # a row for each basis
    both = lines_hash(jobs, line).unionByName(counts, allowMissingColumns=True)
    return both.agg(F.max("n").alias("n"), F.first("basis_counts", ignorenulls=True).alias("basis_counts"), F.max("sha256").alias("selection_sha256"))


def scope_hash(ids: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """(n, sha256) of a list of ids: the digest of its distinct lines in order."""
    return lines_hash(ids.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("line")).distinct(), F.col("line"))
