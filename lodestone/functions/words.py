"""Words of many texts at once, as Arrow arrays: what regular expressions find in small letters, by passes of numpy over their bytes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are held at once, or of one text up to the next blank.
PIECE = 1 << 21
_BLANK, _FIRST = 32, 48  # all letters and digits come from 48 on, `'` and `-` before it

#: Bytes in small letters; all that no word has are blanks.
_LETTERS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else _BLANK for c in range(256))
_JOINED = bytes(c if chr(c) in "'-" else x for c, x in enumerate(_LETTERS))


def _small(text: bytes, joined: bool) -> bytes:
    """Beside A to Z only two characters have small forms in a to z: the Kelvin sign, and an I with a dot, which becomes i and a mark."""
    if not text.isascii():
        text = text.replace(b"\xe2\x84\xaa", b"k").replace(b"\xc4\xb0", b"i ")
    return text.translate(_JOINED if joined else _LETTERS)


def words(texts: Iterable[bytes], joined: bool) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words `[a-z0-9]+` of the texts' small letters (joined: also by single `'` and `-` between such), some texts at a time, and the places of the texts they are of."""
    parts, of, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = _small(text, joined), 0
        while at < len(text):
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            parts.append(text[at:end])
            of.append(i)
            size, at = size + end - at, end
            if size >= PIECE:
                yield _split(parts, of, joined)
                parts, of, size = [], [], 0
    if parts:
        yield _split(parts, of, joined)


def _split(parts: list[bytes], of: list[int], joined: bool) -> tuple[pa.Array, np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    if joined:
        at = np.flatnonzero((data < _FIRST) & (data != _BLANK))
        data = data.copy()
        data[at[(data[at - 1] < _FIRST) | (data[at + 1] < _FIRST)]] = _BLANK
    inside = data != _BLANK
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    begins = np.cumsum([1] + [len(p) + 1 for p in parts])
    return found, np.repeat(np.array(of, np.int64), np.diff(np.searchsorted(starts, begins)))


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_BEGIN = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def md5_digits(found: pa.Array, at_once: int = 1 << 14) -> np.ndarray:
    """The number that the first eight digits of each word's MD5 are; words of one block (55 bytes) are hashed together."""
    parts = [_md5(found[i : i + at_once]) for i in range(0, len(found), at_once)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _md5(found: pa.Array) -> np.ndarray:
    n, (_, offsets, flat) = len(found), found.buffers()
    offsets = np.frombuffer(offsets, np.int32)[found.offset : found.offset + n + 1].astype(np.int64)
    lengths = np.diff(offsets)
    short = np.minimum(lengths, 55)
    block = np.zeros((n, 64), np.uint8)
    col = np.arange(short.sum()) - np.repeat(np.cumsum(short) - short, short)
    block[np.repeat(np.arange(n), short), col] = np.frombuffer(flat or b"", np.uint8)[np.repeat(offsets[:-1], short) + col]
    block[np.arange(n), short] = 0x80
    block[:, 56], block[:, 57] = 8 * short & 255, 8 * short >> 8
    message = np.ascontiguousarray(block.view("<u4").T)
    used = message.any(axis=1)
    a, b, c, d = (np.full(n, x) for x in _BEGIN)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        if used[g]:
            f += message[g]
        turn = np.uint32(_TURNS[i // 16][i % 4])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    digits = (a + _BEGIN[0]).byteswap()
    for i in np.flatnonzero(lengths > 55):
        digits[i] = int(hashlib.md5(found[int(i)].as_py()).hexdigest()[:8], 16)
    return digits
