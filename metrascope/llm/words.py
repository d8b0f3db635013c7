"""Words of texts as numbers: runs of A-Z (lower-cased), 0-9 and what is beyond ASCII."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 8 << 20
#: Each byte's place in a word; what parts words becomes a space.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def slices(texts) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of runs of texts with about ``SLICE`` bytes together."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
        yield at, to
        at = to


def word_places(texts) -> tuple:
    """(distinct words as bytes, number of the word at each place, first place of each text and their end) of an Arrow array of strings; null has no words."""
    import numpy as np
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    # Only bytes below 0x80 change, and to others below it, so UTF-8 stays what it is.
    spaced = (data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b"").translate(_BYTES)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(spaced))
    split = pc.split_pattern(plain, " ")
    pieces = split.flatten()
    full = pc.binary_length(pieces).to_numpy(zero_copy_only=False) > 0
    upto = np.concatenate([[0], np.cumsum(full)])
    words = pieces.filter(pa.array(full)).dictionary_encode()
    first = split.offsets.to_numpy().astype(np.int64)
    return words.dictionary.cast(pa.large_binary()).to_pylist(), words.indices.to_numpy(), upto[first - first[0]]


def runs(places, first, length: int):
    """(places at which a run of so many words of one text begins, its text)."""
    import numpy as np

    n = np.maximum(np.diff(first) - length + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n), text
