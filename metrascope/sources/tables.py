"""Readers with declared schemas: authorship tables, metadata pages, lists, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import date_of_stamp, optional_int, truthy

# Columns that an authorship table must and may have.
REQUIRED = ("work_id", "arxiv_id", "publication_year", "author_id", "primary_subfield")
OPTIONAL = ("publication_month", "referenced_works_count", "authorships_truncated", "authorships_total", "authorships_missing_id")
# A row of a list of papers in Markdown, and an identifier in it; fewer entries mean a broken list.
LIST_ROW = r"^\| \*\*\[(.+?)\]\(([^)]+)\)\*\* \| ([^|]+) \|"
LIST_ID = r"arxiv\.org/(?:abs|pdf|src)/(\d{4}\.\d{4,5})"
LEAST_ENTRIES = 50


def read_authorships(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file as ``validate_authorships`` returns them; columns are matched by header."""
    header = spark.read.option("header", True).csv(path).columns
    if lost := sorted(set(REQUIRED) - set(header)):
        raise ValueError(f"input is missing required columns: {lost}")
    schema = ", ".join(f"`{c}` string" for c in header)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"').csv(path)
    return validate_authorships(raw)


def validate_authorships(raw: DataFrame) -> DataFrame:
    """Typed rows (work_id, arxiv_id, author_id, year, month, subfield, references, truncated, total, missing); bad cells are errors."""
    cell = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    number = lambda c: optional_int(F.col(c), c) if c in raw.columns else F.lit(None).cast("long")
    rows = raw.select(
        cell("work_id").alias("work_id"), cell("arxiv_id").alias("arxiv_id"), cell("author_id").alias("author_id"),
        number("publication_year").alias("year"), number("publication_month").alias("month"),
        F.coalesce(F.nullif(cell("primary_subfield"), F.lit("")), F.lit("unknown")).alias("subfield"),
        number("referenced_works_count").alias("references"),
        (truthy(F.col("authorships_truncated")) if "authorships_truncated" in raw.columns else F.lit(False)).alias("truncated"),
        number("authorships_total").alias("total"), number("authorships_missing_id").alias("missing"))
    return rows.where(checked(authorship_problem()))


def authorship_problem() -> Column:
    """Why a row of authorships is refused; null if it is not."""
    return (
        F.when((F.col("work_id") == "") | (F.col("arxiv_id") == "") | (F.col("author_id") == ""), "work_id, arxiv_id and author_id are required")
        .when(F.col("year").isNull() | ~F.col("year").between(1900, 2100), "publication_year is out of range")
        .when(~F.col("month").between(1, 12), "publication_month is out of range")
        .when(F.col("references") < 0, "referenced_works_count is negative")
        .when(F.col("total") < 1, "authorships_total must be positive")
        .when(F.col("missing") < 0, "authorships_missing_id is negative")
        .when(F.col("missing") > F.col("total"), "missing authorships exceed total authorships")
    )


def checked(problem: Column) -> Column:
    """True, or an error that tells the problem."""
    return F.when(problem.isNull(), True).otherwise(F.raise_error(problem).cast("boolean"))


_PAGE_RECORD = """header struct<_status: string, identifier: string, datestamp: string>,
metadata struct<arXivRaw: struct<id: string, title: string, authors: string, abstract: string, comments: string, categories: string,
`msc-class`: string, `journal-ref`: string, doi: string, license: string,
version: array<struct<_version: string, date: string, size: string>>>>"""


def read_metadata_pages(spark: SparkSession, path: str) -> DataFrame:
    """Papers with their versions from archived OAI pages (plain or gzip, in folders below ``path`` too).

    Deleted records and those without metadata are left out. A submitter's
    name is never read.
    """
    reader = spark.read.format("xml").schema(_PAGE_RECORD).option("rowTag", "record").option("ignoreNamespace", True).option("recursiveFileLookup", True)
    return papers_of(reader.load(path))


def record_struct(record: Column) -> Column:
    """The header and metadata of a record's XML."""
    return F.from_xml(record, f"struct<{_PAGE_RECORD}>", {"ignoreNamespace": "true"})


def papers_of(records: DataFrame, *keep: str) -> DataFrame:
    """Papers with their versions from records (header, metadata), and the columns to keep beside."""
    rows = records.where("metadata.arXivRaw IS NOT NULL AND coalesce(header._status, '') <> 'deleted'")
    m = F.col("metadata.arXivRaw")
    flat = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))
    number = lambda v: F.coalesce(F.regexp_extract(v["_version"], r"(\d+)", 1).try_cast("int"), F.lit(0))
    versions = F.transform(F.coalesce(m["version"], F.expr("array()")), lambda v: F.struct(number(v).alias("version"), F.coalesce(F.date_format(date_of_stamp(v["date"]), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), v["date"]).alias("date"), v["size"].alias("size")))
    rows = rows.select(
        *keep, flat(m["id"]).alias("arxiv_id"), flat(m["title"]).alias("title"), flat(m["authors"]).alias("authors"), F.lit(None).cast("string").alias("submitter"),
        flat(m["abstract"]).alias("abstract"), flat(m["comments"]).alias("comments"), F.coalesce(flat(m["categories"]), F.lit("")).alias("categories"),
        flat(m["msc-class"]).alias("msc_class"), flat(m["journal-ref"]).alias("journal_ref"), flat(m["doi"]).alias("doi"), flat(m["license"]).alias("license"),
        F.array_sort(versions).alias("versions"), F.col("header.datestamp").alias("oai_datestamp"))
    return rows.withColumns({
        "primary_category": F.nullif(F.substring_index("categories", " ", 1), F.lit("")), "created": F.left(F.get("versions", F.lit(0))["date"], F.lit(10)),
        "latest_version": F.array_max(F.transform("versions", lambda v: v["version"])),
    })


def parse_list(lines: DataFrame, col: str = "value", least: int = LEAST_ENTRIES) -> DataFrame:
    """(title, url, subjects, arxiv_id, all_ids) from the rows of a Markdown table; fewer than ``least`` mean a broken list, which is an error."""
    rows = lines.where(F.col(col).rlike(LIST_ROW))
    if (n := rows.limit(least).count()) < least:
        raise ValueError(f"the list has {n} entries; at least {least} are expected")
    part = lambda k: F.regexp_extract(col, LIST_ROW, k)
    ids = F.regexp_extract_all(col, F.lit(LIST_ID), F.lit(1))
    return rows.select(part(1).alias("title"), part(2).alias("url"), F.transform(F.split(part(3), ","), lambda s: F.trim(s)).alias("subjects"), F.get(ids, F.lit(0)).alias("arxiv_id"), ids.alias("all_ids"))


def list_buckets(entries: DataFrame, papers: DataFrame, flagged: DataFrame, months: list[str]) -> DataFrame:
    """``entries`` with the first bucket that applies, each once; of a paper told twice the smallest category counts."""
    known = papers.groupBy("arxiv_id").agg(F.min("primary_category").alias("primary_category"), F.lit(True).alias("_known"))
    met = entries.join(known, "arxiv_id", "left").join(flagged.select("arxiv_id", F.lit(True).alias("_flagged")).distinct(), "arxiv_id", "left")
    bucket = (
        F.when(F.col("arxiv_id").isNull(), "no_arxiv_id")
        .when(~F.substring_index("arxiv_id", ".", 1).isin(*months), "out_of_frame_window")
        .when(F.col("_known").isNull(), "not_in_db")
        .when(~F.coalesce(F.col("primary_category").startswith("math"), F.lit(False)), "out_of_frame_category")
        .when(F.col("_flagged").isNull(), "in_frame_not_flagged")
    )
    return met.withColumn("bucket", bucket.otherwise("in_frame_flagged")).drop("_known", "_flagged")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one a line."""
    return spark.read.text(path).select(F.trim("value").alias("arxiv_id")).where("arxiv_id <> ''").distinct()


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are broken are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """One row per verdict of exported reviews."""
    item = "struct<arxiv_id: string, version: int, verdict: string, categories: array<string>, impact: string, flags: array<string>, tools: string, locations: array<string>, notes: string>"
    rows = spark.read.schema(f"project string, reviewer string, codebook_version string, items array<{item}>").option("multiLine", True).json(path)
    return rows.select("project", "reviewer", "codebook_version", F.posexplode("items").alias("place", "item")).select("project", "reviewer", "codebook_version", "place", "item.*")
