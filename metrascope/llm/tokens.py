"""Byte-level BPE over whole texts, a piece between spaces at a time.

In a run of at most two white space characters that has visible text after it,
each space and line feed starts a pre-token. Texts split there, each distinct piece of a slice of texts is
encoded once, and numpy puts the ids together. Texts with wider runs of white
space are encoded as they are.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator

#: Wider runs, or two at the end: pre-tokens may start elsewhere.
_ANY = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LOOSE = rf"{_ANY}{{3}}|{_ANY}{{2}}\z"
_SPACE = re.compile(r"\s")
#: Bytes of text that are split at a time.
_SPLIT = 8 << 20


class TextEncoder:
    """Little-endian unsigned 32-bit ids of texts, as bytes.

    ``encode_many`` gives them for a list of strings. ``added`` tokens are found
    in texts before anything else, and what stands between them is encoded as
    texts of their own. A worker holds those of
    up to ``most`` pieces of at most 64 characters.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], most: int = 500_000, added: dict[str, int] | None = None):
        self.encode_many, self.most, self.added = encode_many, most, added or {}
        self.pieces: dict[str, bytes] = {}
        self.feed = encode_many(["\n"])[0]

    def texts(self, texts) -> Iterator[bytes]:
        """For each string of an Arrow array; nulls count as empty."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "").cast(pa.large_string())
        found = np.zeros(len(texts), bool)
        for content in self.added:
            found |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if not found.any():
            yield from self._plain(texts)
            return
        # Of several tokens that start at one place, the longest counts.
        any_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        cut = [any_added.split(x) if f else [x] for f, x in zip(found.tolist(), texts.to_pylist(), strict=True)]
        ids = self._plain(pa.array([x for parts in cut for x in parts[::2]], pa.large_string()))
        marks = {x: i.to_bytes(4, "little") for x, i in self.added.items()}
        for parts in cut:
            yield b"".join(marks[x] if k % 2 else next(ids) for k, x in enumerate(parts))

    def _plain(self, texts) -> Iterator[bytes]:
        import numpy as np
        import pyarrow.compute as pc

        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SPLIT, "right")))
            yield from self._slice(texts[at:to])
            at = to

    def _slice(self, texts) -> Iterator[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        loose = pc.match_substring_regex(texts, _LOOSE)
        split = pc.split_pattern(pc.replace_substring(pc.if_else(loose, pa.scalar("", pa.large_string()), texts), "\n", " \n"), " ")
        pieces = split.flatten().dictionary_encode()
        distinct, index = pieces.dictionary.to_pylist(), pieces.indices.to_numpy().copy()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        # A text's first piece has no space before it; a loose text is its own first piece.
        first = index[offsets[:-1]]
        heads = sorted(set(first.tolist()))
        whole = np.flatnonzero(loose.to_numpy(zero_copy_only=False))
        place = np.zeros(len(distinct), index.dtype)
        place[heads] = len(distinct) + np.arange(len(heads))
        index[offsets[:-1]] = place[first]
        index[offsets[:-1][whole]] = len(distinct) + len(heads) + np.arange(len(whole))

        ids = self._pieces(distinct)
        ids += self.encode_many([distinct[i] for i in heads] + [texts[i].as_py() for i in whole.tolist()])
        joined = pa.array(ids, pa.large_binary()).take(pa.array(index))
        at = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1][offsets]
        data = memoryview(joined.buffers()[2] or b"")
        return (bytes(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def _pieces(self, distinct: list[str]) -> list[bytes]:
        ids = list(map(self.pieces.get, distinct))
        new = [i for i, x in enumerate(ids) if x is None]
        if len(self.pieces) + len(new) > self.most:
            self.pieces = {}
        # A piece that starts with a line feed has no space before it.
        told = self.encode_many([distinct[i][1:] if distinct[i][:1] == "\n" else " " + distinct[i] for i in new])
        for i, x in zip(new, told, strict=True):
            piece = distinct[i]
            ids[i] = x = self.feed + x if piece[:1] == "\n" else x
            if len(piece) <= 64:
                self.pieces[piece] = x
        return ids


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """bytes -> rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def _json_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE tokenizer file as ranks; refuses files whose merges are not in the order of their ids."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    if model["model"]["type"] != "BPE" or model["pre_tokenizer"]["type"] != "ByteLevel" or model["pre_tokenizer"]["add_prefix_space"] or model["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    special = {x["content"] for x in model["added_tokens"]}
    of = byte_characters()
    vocab = {bytes(of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
    merged = [vocab[bytes(of[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in model["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError(f"the merges of {path} are not in the order of their ids")
    return vocab


def rank_encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], list[bytes]]:
    """Encodes strings without inner white space by one call, line feeds between them."""
    import numpy as np
    import tiktoken

    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    feed = ranks[b"\n"]

    def many(texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        plain = [i for i, x in enumerate(texts) if len(x) > 1 and not _SPACE.search(x, 1)] if len(texts) > 1 else []
        ids = np.array(encoding.encode_ordinary("".join([texts[i] + "\n" for i in plain])), "<u4")
        ends = (np.flatnonzero(ids == feed) * 4).tolist()
        raw, a = ids.tobytes(), 0
        for i, b in zip(plain, ends, strict=True):
            out[i] = raw[a:b]
            a = b + 4
        return [np.array(encoding.encode_ordinary(t), "<u4").tobytes() if x is None else x for t, x in zip(texts, out, strict=True)]

    return many


_held: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """One object per worker and key."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def added_tokens(path: str) -> dict[str, int]:
    """content -> id of a tokenizer file's added tokens; refuses those that take in more than their own characters."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file)["added_tokens"]
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in tokens):
        raise ValueError(f"{path} has added tokens that depend on what stands around them")
    return {x["content"]: x["id"] for x in tokens}


def library_encoder(path: str, added: bool = False) -> TextEncoder:
    """Ids as the ``tokenizers`` library gives them for this file.

    With ``added``, as by the library's default: control strings in a text are
    their own tokens. Otherwise (the library's ``encode_special_tokens``) they
    are ordinary text.

    The library takes about 1 s a MB. As the file's merges are in the order of
    their ids, merging by rank gives the same ids; tests hold both against each other.
    """
    import public_tokenizers

    return held(("json", path, added), lambda: TextEncoder(rank_encoder(_json_ranks(path), public_tokenizers.PATTERN), added=added_tokens(path) if added else None))
