"""Bounded samples of labelled documents, and scoring of all documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A text of over such a part of a sample's characters is long.
LONG = 256


def _told(labels: DataFrame, label: str, training: Column, id_col: str) -> DataFrame:
    """id, label: one row of each document with a label for training."""
    return labels.where(training & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))


def label_counts(docs: DataFrame, labels: DataFrame, label: str, training: Column, id_col: str = "doc_id") -> tuple[int, int]:
    """How many rows of ``docs`` have either label for training: all of them, not those of a sample. Only ids are shuffled."""
    rows = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("n"))
    told = _told(labels, label, training, id_col)
    found = dict(told.join(rows, F.col(id_col) == F.col("_id")).groupBy("label").agg(F.sum("n")).collect())
    return found.get(0, 0), found.get(1, 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_chars: int | None = None) -> DataFrame:
    """(_doc, label, text) of at most ``per_class`` documents of either label, chosen by a hash of their ids.

    Rows of ``labels`` with a null id or label are left out; of several rows of
    one document, the largest label and the greatest text count. With
    ``most_chars``, documents of a label are taken as long as they have no more
    characters together, and the first in any case: in the order of the hash,
    but those of over a ``LONG``-th of the bound come last, the shortest first,
    so that no long text keeps others out. The sample of ids has at most twice
    ``per_class`` rows and so is broadcast.
    """
    told = _told(labels, label, training, id_col)
    order = [F.xxhash64(F.col(id_col).cast("string")), F.col(id_col)]
    ids = [told.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    chosen = ids[0].unionByName(ids[1]).select(F.col(id_col).alias("_id"), "label")
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if most_chars is not None:
        sizes = rows.select("_doc", F.length("text").alias("n")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "label").agg(F.max("n").alias("n"))
        long = F.when(F.col("n") > most_chars / LONG, F.col("n"))
        turn = W.partitionBy("label").orderBy(F.asc_nulls_first(long), F.xxhash64(F.col("_id").cast("string")), "_id").rowsBetween(W.unboundedPreceding, 0)
        chosen = sizes.withColumns({"upto": F.sum("n").over(turn), "turn": F.count(F.lit(1)).over(turn)}).where((F.col("upto") <= most_chars) | (F.col("turn") == 1)).select("_id", "label")
    return rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_doc", "label").agg(F.max("text").alias("text"))


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and what else the model tells of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type, more = to_arrow_type(kind), model.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = model.score(batch.column(1))
            yield pa.record_batch([batch.column(0).cast(id_type), *[pa.array(told[c], t) for c, (_, t) in more.items()]], ["id", *more])

    schema = ", ".join([f"id {kind.simpleString()}", *[f"{c} {t}" for c, (t, _) in more.items()]])
    return docs.select(id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def keep_documents(docs: DataFrame, model, keep, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, whose scores ``keep`` accepts (array of scores to array of booleans)."""
    names, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(model.score(batch.column(place))["score"]))).rename_columns(names)

    # Plain names on the way, as those of columns may hold any characters.
    return docs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, docs.schema)
