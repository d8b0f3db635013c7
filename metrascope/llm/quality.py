"""Quality by Bradley-Terry ranking.

Training pairs set a document of label 1 against one of label 0. The logistic
loss on the difference of their features fits a score, of which the quantile
at the share of label 0 among all training rows becomes the threshold; sampled
rows weigh as many rows as they stand for. Features
are shares of characters, words and lines, each told as its quantile bin.

The fit runs on the driver, on the features of at most ``PER_CLASS`` labelled
documents of either label; scoring covers every row and whole texts, in one
pass and without a shuffle.

Defined results: null text counts as empty, and empty texts are scored like
others; repeated rows are scored alike; without labels of both kinds all scores
are the share of label 1 (0.5 without any); very long texts count in full, each
by itself; a score of exactly 0.5 is good, and rows of equal scores at the
threshold stay together; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, read, text_split
from .labelled import keep_documents, label_counts, labelled_sample, score_documents

#: Labelled documents of either label that a fit may use at most.
PER_CLASS = 10_000
#: Quantile bins of a feature, and pairs that a fit compares.
BINS, PAIRS = 12, 40_000

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARK = b".,;:'\"-()"
_ODD = bytes(b for b in range(33, 127) if b not in _MARK and not chr(b).isalnum())

FEATURES = (
    "log_chars", "word_length", "upper", "digits", "marks", "odd", "distinct_words", "repeated_words", "line_length",
    "distinct_lines", "sentence_length", "distinct_share", "long_words", "marked_words",
)


def text_features(text: str) -> tuple[float, ...]:
    """The features of one text, in the order of ``FEATURES``."""
    import math

    raw = text.encode()
    words, lines = raw.split(), raw.split(b"\n")
    n, size = max(1, len(words)), max(1, len(raw))
    less = lambda chars: 1 - len(raw.translate(None, chars)) / size if raw else 0.0
    odd = less(_ODD)
    return (
        math.log1p(len(raw)),
        (len(raw) - len(lines)) / n,
        less(_UPPER),
        less(_DIGIT),
        less(_MARK),
        odd,
        len(set(words)) / n / (1 + math.log1p(n)) * 4,
        sum(map(operator.eq, words, words[1:])) / n,
        math.log1p(len(raw) / len(lines)),
        len(set(lines)) / len(lines),
        n / (1 + raw.count(b".") + raw.count(b"!") + raw.count(b"?")),
        len(set(words)) / n,
        len(raw.translate(None, ASCII_SPACE)) / n,
        odd * size / n,
    )


def feature_matrix(texts: list[str | None]):
    import numpy as np

    return np.array([text_features(t or "") for t in texts], float).reshape(len(texts), len(FEATURES))


class QualityModel:
    """Bin edges of each feature and the worth of each bin; the threshold; or a constant score."""

    columns = {"score": ("double", pa.float64())}

    def __init__(self, edges=None, worth=None, threshold: float = 0.0, constant: float | None = None):
        self.edges, self.worth, self.threshold, self.constant = edges, worth, threshold, constant

    def margin(self, x):
        return sum(self.worth[j][self.edges[j].searchsorted(x[:, j], "right")] for j in range(len(self.edges)))

    def score(self, texts) -> dict:
        import numpy as np

        if self.constant is not None:
            return {"score": np.full(len(texts), self.constant)}
        # A few texts at a time: each is turned into Python's strings.
        parts = [self.margin(feature_matrix(texts[i : i + 256].to_pylist())) for i in range(0, len(texts), 256)]
        return {"score": 1 / (1 + np.exp(np.clip(self.threshold - np.concatenate(parts or [np.zeros(0)]), -500, 500)))}


def fit(x, label, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, counts: tuple[int, int] | None = None) -> QualityModel:
    """Adam on the logistic loss of pairs drawn with a fixed seed.

    ``counts``: rows of label 0 and of label 1 that the given rows were drawn from, if these are a sample.
    """
    import numpy as np

    y = np.asarray(label, int)
    if not len(y) or y.min() == y.max():
        return QualityModel(constant=float(y.mean()) if len(y) else 0.5)
    balanced = [x[y == k] for k in (0, 1)]
    edges = [np.unique(np.concatenate([np.quantile(part[:, j], np.arange(1, BINS) / BINS) for part in balanced])) for j in range(x.shape[1])]
    start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    bins = np.stack([start[j] + edges[j].searchsorted(x[:, j], "right") for j in range(x.shape[1])], axis=1)
    draw = np.random.default_rng(11)
    better, worse = (draw.choice(np.flatnonzero(y == k), PAIRS) for k in (1, 0))
    theta = np.zeros(start[-1])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    up, down = bins[better].ravel(), bins[worse].ravel()
    for step in range(1, rounds + 1):
        worth = theta[bins].sum(axis=1)
        slope = -1 / (1 + np.exp(np.clip(worth[better] - worth[worse], -500, 500))) / PAIRS
        each = np.repeat(slope, x.shape[1])
        grad = np.bincount(up, each, len(theta)) - np.bincount(down, each, len(theta)) + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    worth, drawn = theta[bins].sum(axis=1), np.bincount(y, minlength=2)
    counts = np.maximum(drawn if counts is None else counts, drawn)
    order = np.argsort(worth, kind="stable")
    reached = np.cumsum((counts / drawn)[y[order]])
    # The first row by which as many rows are reached as have label 0.
    last = min(int(np.searchsorted(reached, counts[0] * (1 - 1e-9))), len(y) - 2)
    model = QualityModel(edges, [theta[start[j] : start[j + 1]] for j in range(x.shape[1])])
    model.threshold = float((worth[order[last]] + worth[order[last + 1]]) / 2)
    return model


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """A model from the labelled rows whose crc32 modulo 3 is not 1."""
    training = ~text_split(id_col, 1, 3)
    rows = labelled_sample(docs, labels, "quality", training, per_class, id_col, text_col)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = feature_matrix(batch.column(0).to_pylist())
            yield pa.record_batch([pa.array(found.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "label"])

    import numpy as np

    got = sorted((r["label"], tuple(r["x"])) for r in rows.select("text", "label").mapInArrow(told, "x array<double>, label int").collect())
    return fit(np.array([x for _, x in got], float).reshape(len(got), len(FEATURES)), [k for k, _ in got], counts=label_counts(docs, labels, "quality", training, id_col))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, repeated ones too, with a score of at least 0.5 and all their columns, whatever their names; nulls and empty texts are scored like others."""
    return keep_documents(docs, fit_on(docs, labels), lambda score: score >= 0.5)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    told = score_documents(docs, fit_on(docs, read(spark, sf_dir, "labels")))
    return told.select("doc_id", text_split("doc_id", 1, 3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
