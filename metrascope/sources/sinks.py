"""Writers: metrics tables, manifests, append-only tables with committed runs."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.concentration import FIELDS
from ..operators.sessions import latest
from ..workspace import written


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """One CSV file with a header and a fixed order of columns and rows; the table has one row a year and scope."""
    metrics.select(*FIELDS).orderBy("year", "scope").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Version of the tables of runs; readers refuse others.
SCHEMA_VERSION = 1
COMMIT = "run_id string, schema_version int, protocol_sha256 string"


def _run_name(run_id: str) -> str:
    if not re.fullmatch(r"[\w.-]+", run_id):
        raise ValueError(f"a run's id has letters, digits, '.', '-' and '_': {run_id!r}")
    return f"run_id={run_id}"


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """A row (``COMMIT`` and what else was told) of each run that counts."""
    folders = [f"{root}/runs/{x}" for x in written(spark, f"{root}/runs")]
    if not folders:
        return spark.createDataFrame([], COMMIT)
    schema = spark.read.option("mergeSchema", True).parquet(*folders).schema
    return spark.read.schema(schema.add("run_id", "string")).option("basePath", f"{root}/runs").parquet(*folders)


def write_run(tables: dict[str, DataFrame], root: str, run_id: str, runs: DataFrame, protocol_sha256: str = "", version: int = SCHEMA_VERSION) -> None:
    """Writes a run's tables, each in a folder of its own, then the row of ``runs`` that makes them count.

    Written again after a crash, a run replaces what it has left, and no other's
    rows; one that counts already is refused, as its readers may be at work.
    """
    spark, name = runs.sparkSession, _run_name(run_id)
    if name in written(spark, f"{root}/runs"):
        raise ValueError(f"run {run_id} is committed")
    for table, df in tables.items():
        df.drop("run_id").write.mode("overwrite").parquet(f"{root}/{table}/{name}")
    row = runs.where(F.col("run_id") == run_id).limit(1).withColumns({"schema_version": F.lit(version), "protocol_sha256": F.lit(protocol_sha256)})
    row.drop("run_id").coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/{name}")


def read_runs(spark: SparkSession, root: str, name: str, run_ids: Sequence[str] | None = None, protocol_sha256: str | None = None, version: int = SCHEMA_VERSION) -> DataFrame:
    """A table of committed runs, with run_id; the partition filter prunes all others.

    Runs that were never committed do not show, and are an error if asked for;
    so is any of another version of tables or, if given, another protocol.
    """
    told = {r["run_id"]: r for r in committed_runs(spark, root).select(*[c.split()[0] for c in COMMIT.split(", ")]).collect()}  # a row for each run
    asked = sorted(told) if run_ids is None else list(run_ids)
    if lost := [x for x in asked if x not in told] or ([] if asked else ["any"]):
        raise ValueError(f"not committed: {lost}")
    if other := [x for x in asked if told[x]["schema_version"] != version]:
        raise ValueError(f"tables of another version than {version}: {other}")
    if other := [x for x in asked if protocol_sha256 is not None and told[x]["protocol_sha256"] != protocol_sha256]:
        raise ValueError(f"runs of another protocol: {other}")
    schema = spark.read.option("mergeSchema", True).parquet(*[f"{root}/{name}/{_run_name(x)}" for x in asked]).schema
    return spark.read.schema(schema.add("run_id", "string")).parquet(f"{root}/{name}").where(F.col("run_id").isin(*asked))


def read_run(spark: SparkSession, root: str, name: str, run_id: str, protocol_sha256: str | None = None, version: int = SCHEMA_VERSION) -> DataFrame:
    """A table of one committed run."""
    return read_runs(spark, root, name, [run_id], protocol_sha256, version)


def current_runs(events: DataFrame) -> DataFrame:
    """The last status of each run from its append-only events."""
    return latest(events, ["run_id"], F.struct("at"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, list(keys), F.col("_new")).drop("_new")


def write_manifest(path: str, counts: DataFrame, **facts: object) -> dict:
    """A JSON file of facts and the single row of ``counts``."""
    told = {**facts, **counts.first().asDict()}
    Path(path).write_text(json.dumps(told, indent=2, sort_keys=True, default=str) + "\n")
    return told


def write_report(cells: DataFrame, path: str) -> None:
    """The cells of a report (section, name, n) as JSON: a line for each section, an object of its names."""
    told = cells.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("counts"))
    told.orderBy("section").coalesce(1).write.mode("overwrite").json(path)


def write_series(rates: DataFrame, keys: Sequence[str], order: str, path: str) -> None:
    """Series as JSON: a line for each value of ``keys``, with the points of its series in order as an array of objects."""
    rest = [c for c in rates.columns if c not in keys]
    points = F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias("points")
    rates.groupBy(*keys).agg(points).orderBy(*keys).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines beside those that are there; none is ever rewritten."""
    rows.write.mode("append").json(path)


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def svg_lines(title: str, points: dict[str, list[tuple[float, float | None]]], width: int = 480, height: int = 260) -> str:
    """A small line chart as SVG text; a missing value breaks the line."""
    xs = [x for line in points.values() for x, _ in line]
    ys = [y for line in points.values() for _, y in line if y is not None]
    if not ys:
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{title}</title></svg>'
    low, high = min(ys), max(ys) if max(ys) > min(ys) else min(ys) + 1
    left, right = min(xs), max(xs) if max(xs) > min(xs) else min(xs) + 1
    place = lambda x, y: f"{40 + (x - left) / (right - left) * (width - 60):.1f},{height - 30 - (y - low) / (high - low) * (height - 60):.1f}"
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{title}</title>']
    for k, (name, line) in enumerate(points.items()):
        runs, now = [], []
        for x, y in [*line, (0.0, None)]:
            if y is None:
                runs, now = [*runs, now] if now else runs, []
            else:
                now.append(place(x, y))
        parts += [f'<polyline fill="none" stroke="hsl({k * 67 % 360} 60% 40%)" points="{" ".join(r)}"><title>{name}</title></polyline>' for r in runs]
    return "".join(parts) + "</svg>"
