"""Cells of text tables and JSON labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of true.
TRUE_WORDS = ("1", "true", "yes")


def optional_int(c: Column, name: str) -> Column:
    """Blank is null; what is no integer is an error."""
    cell = F.nullif(F.trim(c), F.lit(""))
    wrong = F.raise_error(F.concat(F.lit(f"{name} is no integer: "), cell)).cast("long")
    return F.when(cell.isNull(), F.lit(None).cast("long")).when(cell.rlike(r"^[+-]?\d+$"), cell.cast("long")).otherwise(wrong)


def truthy(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*TRUE_WORDS)


def date_of_stamp(c: Column) -> Column:
    """A timestamp from an RFC 2822 stamp such as ``Mon, 2 Apr 2007 19:18:42 GMT``; null if it is none."""
    return F.try_to_timestamp(F.regexp_extract(c, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))


def status_class(c: Column) -> Column:
    """What stands before the first colon of a status."""
    return F.substring_index(c, ":", 1)


def version_at_least(c: Column, *least: int) -> Column:
    """Whether a dotted version, compared number by number, reaches ``least``."""
    return F.split(c, r"\.").cast("array<int>") >= F.array(*[F.lit(x) for x in least])
