"""Toxicity by multiple-instance learning.

A document is a bag of sentences. The probability of a sentence is a logistic
function of its words; that of the document is their noisy-or,
``1 - prod(1 - p)``. Only documents have labels: their cross-entropy is
differentiated through the noisy-or down to weights of words and of beginnings
of words. The probabilities of sentences then locate what offends.

Executors turn the labelled documents into numbers, at most ``PER_CLASS``
documents and ``MOST_CHARS`` characters of either label; one task fits the
model to these, and only the model comes to the driver. Texts over
``MOST_CHARS`` / 256 characters take part in the fit only where shorter ones
leave room. Scoring covers every row and whole texts, in one pass and without a
shuffle.

Defined results: null text counts as empty, and an empty text has the score of
one empty sentence; repeated rows are scored alike; without labels of both
kinds all scores are the share of toxic labels (0.5 without any); very long
texts are scored in full, a few megabytes at a time; a score of exactly 0.5 is
toxic; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_split
from .labelled import keep_documents, labelled_sample, score_documents

#: Labelled documents of either label that a fit may use at most.
PER_CLASS = 4000
#: Characters that these may have together, for either label.
MOST_CHARS = 32 << 20
#: Weights are held by hash of a feature, modulo this number.
BUCKETS = 1 << 17
#: Lengths of the beginnings of words that are features beside the whole word.
PREFIXES = (3, 4, 5, 6)
#: Documents of the sample that have a feature, at least.
LEAST_DOCS = 5
#: Characters of a piece at most; longer ones are cut.
LONGEST = 64
_WORD = re.compile(r"[^\W_]+")
_ENDS = (".", "!", "?", "\n", "。", "！", "？", "｡")
#: White space beside the space and the line feed (for RE2), and ends of sentences that no space follows.
_ODD_SPACE = r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_WIDE_END = r"([。！？｡])([^\s。！？｡])"
#: Scripts that are written without spaces: Thai to Tibetan, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\U00020000-\U0003ffff]")
#: Punctuation after which long pieces are cut, with what stands before it.
_MARKS = r"!-/:-@\[-`{-~\u2010-\u206f\u3001-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_RUN = re.compile(rf"[^{_MARKS}]*[{_MARKS}]+|[^{_MARKS}]+")
#: Bytes of text handled at a time.
_SLICE = 4 << 20
#: Texts, and places of pieces, that a fit handles at a time.
_TEXTS, _PLACES = 256, 1 << 18


def word_features(piece: str) -> list[int]:
    """Buckets of a piece of text between spaces.

    A word, letters and digits between other characters, gives itself and its
    beginnings. Where words cannot be told (scripts without spaces, pieces of
    ``LONGEST`` characters), the strings of two to six characters at every place
    count, too; the longer ones are named like beginnings.
    """
    low = piece.lower()
    names = set()
    for word in _WORD.findall(low):
        names.update(("w" + word, *(f"p{word[:n]}" for n in PREFIXES if len(word) > n)))
    if names and (len(piece) >= LONGEST or not piece.isascii() and _UNSPACED.search(piece)):
        names.update(f"c{low[i : i + 2]}" for i in range(len(low) - 1))
        names.update(f"p{low[i : i + n]}" for n in PREFIXES for i in range(len(low) - n + 1))
    return [zlib.crc32(x.encode()) % BUCKETS for x in sorted(names)]


def cut_piece(piece: str) -> tuple[list[str], list[bool]]:
    """The parts of a long piece, and whether a sentence ends after each.

    It is cut after punctuation. Parts that are still long become windows of
    ``LONGEST`` characters, each a sentence; neighbours overlap, so
    that no string of up to six characters is lost between them.
    """
    parts, ends = [], []
    for run in _RUN.findall(piece):
        if len(run) <= LONGEST:
            parts.append(run)
            ends.append(False)
            continue
        # The last window is whole, too, and so treated like the others.
        starts = [*range(0, len(run) - LONGEST, LONGEST - max(PREFIXES) + 1), len(run) - LONGEST]
        parts += [run[k : k + LONGEST] for k in starts]
        ends += [True] * len(starts)
    ends[-1] = ends[-1] or piece.endswith(_ENDS)
    return parts, ends


def split_sentences(texts) -> tuple:
    """(distinct pieces, piece of each place, sentence of each place, document of each sentence).

    Pieces stand between white space of any kind; those over ``LONGEST``
    characters are cut by ``cut_piece``. Sentences end after a piece that ends
    in . ! or ? (or their wide forms, which no space need follow), and at line
    feeds. Every document has one sentence at least.
    """
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
        texts = pc.replace_substring_regex(texts, _ODD_SPACE, " ")
    if pc.any(pc.match_substring_regex(texts, _WIDE_END)).as_py():
        texts = pc.replace_substring_regex(texts, _WIDE_END, r"\1 \2")
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
    pieces = split.flatten().dictionary_encode()
    distinct, index = pieces.dictionary.to_pylist(), pieces.indices.to_numpy()
    offsets = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    ends = np.fromiter((x.endswith(_ENDS) for x in distinct), bool, len(distinct))
    long = [i for i, x in enumerate(distinct) if len(x) > LONGEST]
    if long:
        first, n, more = np.arange(len(distinct), dtype=np.int32), np.ones(len(distinct), np.int32), []
        for i in long:
            parts, after = cut_piece(distinct[i])
            first[i], n[i], distinct[i] = len(distinct), len(parts), ""
            distinct += parts
            more += after
        ends = np.concatenate([ends, np.array(more, bool)])
        times = n[index]
        at = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
        index = (np.repeat(first[index] - at[:-1], times) + np.arange(at[-1])).astype(np.int32)
        offsets = at[offsets]
    ends = ends[index]
    new = np.zeros(len(index), bool)
    new[1:] = ends[:-1]
    new[offsets[:-1]] = True
    sentence = np.cumsum(new) - 1
    return distinct, index, sentence.astype(np.int32), np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(offsets))[new]


class ToxicityModel:
    """Weights of hashed features, the intercept of a sentence, or a constant score."""

    columns = {"score": ("double", pa.float64()), "n_sentences": ("long", pa.int64()), "n_offending": ("long", pa.int64())}

    def __init__(self, weights=None, intercept: float = 0.0, constant: float | None = None):
        self.weights, self.intercept, self.constant = weights, intercept, constant
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def _worth(self, pieces: list[str]):
        import numpy as np

        known, out = self.known, np.empty(len(pieces))
        if len(known) > 200_000:
            known.clear()
        for i, x in enumerate(pieces):
            worth = known.get(x)
            if worth is None:
                worth = float(sum(self.weights[f] for f in word_features(x)))
                if len(x) <= LONGEST:
                    known[x] = worth
            out[i] = worth
        return out

    def sentences(self, texts) -> tuple:
        """(probability, document) of each sentence of an Arrow array of texts."""
        import numpy as np

        distinct, index, sentence, doc = split_sentences(texts)
        z = self.intercept + np.bincount(sentence, self._worth(distinct)[index], len(doc))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500))), doc

    def score(self, texts) -> dict:
        import numpy as np
        import pyarrow.compute as pc

        told = {c: [] for c in self.columns}
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, "right")))
            if self.constant is not None:
                p, doc = np.full(to - at, self.constant), np.arange(to - at)
            else:
                p, doc = self.sentences(texts[at:to])
            told["score"].append(-np.expm1(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-15)), to - at)))
            told["n_sentences"].append(np.bincount(doc, minlength=to - at))
            told["n_offending"].append(np.bincount(doc, p >= 0.5, to - at).astype(np.int64))
            at = to
        return {c: np.concatenate(x) if x else np.zeros(0) for c, x in told.items()}


#: What a fit needs of texts: of a document, its label and, place by place, hashes of pieces (64 bits) and numbers of
#: sentences (32 bits); of a few documents, each piece's hash, its number of features, and these (32 bits).
_BAGS = pa.schema([("label", pa.int32()), ("pieces", pa.binary()), ("sentences", pa.binary()), ("names", pa.binary()), ("n_features", pa.binary()), ("features", pa.binary())])


def bags(texts, labels) -> pa.RecordBatch:
    """Rows of ``_BAGS`` of an Arrow array of texts."""
    import numpy as np
    import xxhash

    distinct, index, sentence, doc = split_sentences(texts)
    names = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct), np.uint64, len(distinct)).view(np.int64)
    found = [word_features(x) for x in distinct]
    features = np.fromiter((f for fs in found for f in fs), np.int32)
    at = np.searchsorted(doc[sentence], np.arange(len(texts) + 1))
    own = [(names[index[a:b]].tobytes(), (sentence[a:b] - sentence[a]).tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
    none = [None] * len(own)
    rows = [*zip(labels, *(zip(*own, strict=True) if own else ((), ())), none, none, none, strict=True), (None, None, None, names.tobytes(), np.array([len(f) for f in found], np.int32).tobytes(), features.tobytes())]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BAGS, strict=True)], schema=_BAGS)


def fit(texts: list[str], toxic: list[int], rounds: int = 150, rate: float = 0.15, sparsity: float = 5e-4) -> ToxicityModel:
    """A model from texts."""
    parts = [bags(pa.array(texts[k : k + _TEXTS], pa.string()), [int(x) for x in toxic[k : k + _TEXTS]]) for k in range(0, len(texts), _TEXTS)]
    return fit_bags([r for b in parts for r in zip(*[c.to_pylist() for c in b.columns], strict=True)], rounds, rate, sparsity)


def fit_bags(rows: list[tuple], rounds: int = 150, rate: float = 0.15, sparsity: float = 5e-4) -> ToxicityModel:
    """Full-batch Adam on the cross-entropy of noisy-or documents, documents of either label weighing as much; ``rows`` of ``_BAGS``."""
    import numpy as np

    told = [r[3:] for r in rows if r[0] is None]
    rows = sorted(r[:3] for r in rows if r[0] is not None)
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return ToxicityModel(constant=float(y.mean()) if len(y) else 0.5)
    joined = lambda k, kind: np.frombuffer(b"".join(r[k] for r in told), kind)
    names, counts, held = joined(0, np.int64), joined(1, np.int32), joined(2, np.int32)
    # A piece that several tasks tell of counts once.
    known, first = np.unique(names, return_index=True)
    n_features = counts[first].astype(np.int64)
    ends = np.cumsum(n_features)
    feature = held[np.repeat((np.cumsum(counts, dtype=np.int64) - counts)[first] - (ends - n_features), n_features) + np.arange(ends[-1] if len(ends) else 0)]
    first = ends - n_features
    distinct = len(known)
    sizes = np.array([len(r[1]) // 8 for r in rows])
    index = np.searchsorted(known, np.frombuffer(b"".join(r[1] for r in rows), np.int64)).astype(np.int32)
    sentence = np.frombuffer(b"".join(r[2] for r in rows), np.int32)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    in_doc = sentence[upto[1:] - 1].astype(np.int64) + 1  # every document has a place
    doc = np.repeat(np.arange(len(y), dtype=np.int32), in_doc)
    sentence = sentence + np.repeat((np.cumsum(in_doc) - in_doc).astype(np.int32), sizes)
    del rows, told, names, counts, held
    word = np.repeat(np.arange(distinct, dtype=np.int32), n_features)
    # Features of under LEAST_DOCS documents tell these documents apart and nothing else.
    seen, places = np.zeros(BUCKETS, np.int64), np.searchsorted(doc[sentence], np.arange(len(y) + 1))
    for a, b in zip(places[:-1], places[1:], strict=True):
        words = np.unique(index[a:b])
        n = n_features[words]
        at = np.repeat(first[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        seen[np.unique(feature[at])] += 1
    word, feature = word[seen[feature] >= LEAST_DOCS], feature[seen[feature] >= LEAST_DOCS]
    used, feature = np.unique(feature, return_inverse=True)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    theta, b = np.zeros(len(used) + 1), -math.log(4 * max(1.0, len(doc) / len(y)))
    theta[-1] = b
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    slices = [slice(k, k + _PLACES) for k in range(0, len(index), _PLACES)]
    for step in range(1, rounds + 1):
        worth = np.bincount(word, theta[feature], distinct)
        z = np.full(len(doc), theta[-1])
        for k in slices:
            low, high = sentence[k][0], sentence[k][-1] + 1
            z[low:high] += np.bincount(sentence[k] - low, worth[index[k]], high - low)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y))  # log of the product
        bag = np.clip(-np.expm1(clean), 1e-9, 1)
        # d loss / d z of a sentence: p for clean documents, -p (1 - bag) / bag for toxic ones.
        slope = p * (weight * np.where(y > 0, -np.exp(clean) / bag, 1.0))[doc]
        own = np.zeros(distinct)
        for k in slices:
            own += np.bincount(index[k], slope[sentence[k]], distinct)
        grad = np.concatenate([np.bincount(feature, own[word], len(used)), [slope.sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        pace = rate / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        theta -= pace * (m / (1 - 0.9**step))
        # Proximal step of the absolute penalty: most features end at zero.
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - pace[:-1] * sparsity, 0)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = theta[:-1]
    return ToxicityModel(weights, float(theta[-1]))


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from the labelled rows whose crc32 is not divisible by 5."""
    rows = labelled_sample(docs, labels, "toxic", ~text_split(id_col, 0, 5), per_class, id_col, text_col, MOST_CHARS)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(k, _TEXTS)
                yield bags(part.column(0), part.column(1).to_pylist())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_bags([r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True)])
        weights = None if model.weights is None else model.weights.tobytes()
        yield pa.record_batch([pa.array([weights], pa.binary()), pa.array([model.intercept], pa.float64()), pa.array([model.constant], pa.float64())], ["weights", "intercept", "constant"])

    import numpy as np

    kinds = ", ".join(f"{f.name} {'int' if f.name == 'label' else 'binary'}" for f in _BAGS)
    told = rows.select("text", "label").mapInArrow(told, kinds).repartition(1)
    fitted = told.mapInArrow(learn, "weights binary, intercept double, constant double").collect()
    if not fitted:
        return fit_bags([])
    return ToxicityModel(None if fitted[0]["weights"] is None else np.frombuffer(fitted[0]["weights"], np.float32), fitted[0]["intercept"], fitted[0]["constant"])


def locate_sentences(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, sentence (number), text (parts and white space as words between spaces), probability of every sentence of at least that probability."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if model.constant is not None:
                    continue
                array = pa.array([text or ""])
                p, _ = model.sentences(array)
                if p.max() < least:
                    continue
                distinct, index, sentence, _ = split_sentences(array)
                for k in range(len(p)):
                    if p[k] >= least:
                        said = " ".join(distinct[i] for i in index[sentence == k]).strip()
                        for column, value in zip(out, (key, k, said, float(p[k])), strict=True):
                            column.append(value)
            yield pa.record_batch([pa.array(out[0], id_type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64())], ["id", "sentence", "text", "probability"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind.simpleString()}, sentence long, text string, probability double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, repeated ones too, with a score below 0.5 and all their columns, whatever their names; nulls and empty texts are scored like others."""
    return keep_documents(docs, fit_on(docs, labels), lambda score: score < 0.5)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    told = score_documents(docs, fit_on(docs, read(spark, sf_dir, "labels")))
    return told.select("doc_id", text_split("doc_id", 0, 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_offending")
