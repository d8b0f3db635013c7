"""Byte-level BPE through a sentencepiece model made from the vocabulary.

The model is serialised directly: each token is a piece whose characters stand
for its bytes, its score the negative rank, so that sentencepiece's merges, by
best score and then from the left, are merges by rank. Normalisation is the
identity. Texts are split into pre-tokens, which are encoded one by one; the
inverse mapping of pieces decodes ids.

Defined results: null text counts as empty, and has no ids; repeated rows and
null ids are rows like others; very long texts are encoded in full, pre-token
by pre-token; of merges of one rank the leftmost comes first; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tokens import TextEncoder, held, read_ranks

#: Byte b is written as the character at this place plus b; none of these is white space or a mark of sentencepiece.
BYTE_BASE = 0x2800
_TO_CHARACTERS = {b: chr(BYTE_BASE + b) for b in range(256)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes | float) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece i is the token of rank i, and the unknown piece follows.

    Ranks have to be 0, 1, 2, ... and to include every single byte.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks have to be consecutive and to include all bytes")
    # Messages of sentencepiece_model.proto: 1 pieces (1 piece, 2 score, 3 type), 2 trainer (3 model type,
    # 4 vocabulary size, 40-43 ids of unknown, begin, end, padding), 3 normalizer (1 name, 3-5 white space rules).
    normal, unknown, bpe, none = 1, 2, 2, (1 << 64) - 1
    pieces = [_field(1, _field(1, t.decode("latin-1").translate(_TO_CHARACTERS).encode()) + _field(2, float(-r)) + _field(3, normal)) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes texts with the ranks of a file."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(ranks))
        self.split = regex.compile(pattern).findall
        self.encoder = TextEncoder(self._encode_many)

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        split = [self.split(x) for x in texts]
        distinct = list({p: None for s in split for p in s})
        shown = [p.encode().decode("latin-1").translate(_TO_CHARACTERS) for p in distinct]
        told = dict(zip(distinct, self.model.encode(shown, num_threads=1), strict=True)) if distinct else {}
        return [np.array([i for p in s for i in told[p]], "<u4").tobytes() for s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


def codec(path: str, pattern: str) -> Codec:
    return held(("sentencepiece", path, pattern), lambda: Codec(path, pattern))


def _map(path: str, pattern: str, id_type: pa.DataType, emit: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            yield from emit(own, batch)

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary, little-endian unsigned 32-bit) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def emit(own: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch([batch.column(0).cast(id_type), pa.array(list(own.encoder.texts(batch.column(1))), pa.binary())], ["id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(_map(path, pattern, id_type, emit), f"id {kind.simpleString()}, ids binary").withColumnRenamed("id", id_col)


def round_trips(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, number of ids, SHA-256 of ids and of the bytes decoded from them: both ways in one pass over the texts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def emit(own: Codec, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, coded, back = [], [], []
        for ids in own.encoder.texts(batch.column(1)):
            n.append(len(ids) // 4)
            coded.append(hashlib.sha256(ids).hexdigest())
            back.append(hashlib.sha256(own.decode(ids)).hexdigest())
        yield pa.record_batch([batch.column(0).cast(id_type), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(_map(path, pattern, id_type, emit), schema).withColumnRenamed("id", id_col)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
