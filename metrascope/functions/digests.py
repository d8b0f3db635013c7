"""SHA-256 that one task begins and another goes on with."""

from __future__ import annotations

import ctypes
from functools import cache


@cache
def _library() -> ctypes.CDLL:
    """OpenSSL as Python's own hashlib has loaded it; unlike that, it tells the state of a hash."""
    import _hashlib

    told = ctypes.CDLL(_hashlib.__file__)
    told.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
    return told


class SHA256:
    """A hash whose state can be sent on; ``size`` counts the bytes that it has met."""

    #: Bytes of OpenSSL's SHA256_CTX: eight words, a count of bits, a block, and how full that is.
    CONTEXT = 112

    def __init__(self, context: bytes, size: int):
        self._context, self.size = ctypes.create_string_buffer(context, self.CONTEXT), size

    @classmethod
    def start(cls) -> bytes:
        context = ctypes.create_string_buffer(cls.CONTEXT)
        _library().SHA256_Init(context)
        return bytes(8) + context.raw

    @classmethod
    def go_on(cls, state: bytes) -> SHA256:
        return cls(state[8:], int.from_bytes(state[:8], "little"))

    @classmethod
    def end(cls, state: bytes) -> str:
        digest, context = ctypes.create_string_buffer(32), ctypes.create_string_buffer(state[8:], cls.CONTEXT)
        _library().SHA256_Final(digest, context)
        return digest.raw.hex()

    def update(self, data: bytes) -> None:
        _library().SHA256_Update(self._context, data, len(data))
        self.size += len(data)

    def state(self) -> bytes:
        return self.size.to_bytes(8, "little") + self._context.raw
