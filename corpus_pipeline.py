"""From raw documents to packed training sequences, by the operators of metrascope.llm.

Toxic and low-quality documents go, then exact and near copies; what is left is
packed. Each stage works on all that its predecessor kept, and all but the last
return the columns of ``documents``.

All stages take null ids and texts, empty and very long texts, repeated rows,
extra columns of any names, and tables without rows. Null text counts as empty;
rows are judged one by one, so that ids may repeat; columns that a stage does
not know stay as they are. Each stage says how it settles ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metrascope.llm.common import Workspace, read
from metrascope.llm.exact_dedup import drop_exact_duplicates
from metrascope.llm.jaccard_join import drop_near_duplicates
from metrascope.llm.packing import pack
from metrascope.llm.quality import drop_low_quality
from metrascope.llm.toxicity import drop_toxic


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity below 0.5; a score of exactly 0.5 goes. Without labels of both kinds all rows are as toxic as the labels' mean."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality of at least 0.5. The threshold is that of the labelled rows of ``docs``, toxic ones gone."""
    return drop_low_quality(docs, read(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, the row with the most code points, then the smallest id, then the first; all empty texts are one group."""
    return drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a similarity of 0.8 or more, the row with the smallest id, then the first; texts without words all stay."""
    return drop_near_duplicates(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all that is left, in as few sequences of 2,048 tokens as best-fit makes of them; an empty text is one token."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("quality", of_quality),
    ("exact_dedup", without_copies),
    ("near_duplicates", without_near_copies),
    ("packing", packed),
]

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
