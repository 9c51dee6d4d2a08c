"""Byte-level BPE encoding and decoding (operator 9).

A pretoken's bytes are mapped to Latin-1 so that an Aho-Corasick automaton over
the vocabulary finds, in one pass, the longest token at every place.  The
encoder then walks left to right, taking the longest token that may stand next
to the one before it, and goes back when none fits; places proved to be dead
ends are marked, so the walk is linear in the text.  Whether two tokens may be
neighbours (whether merging by rank would leave their border alone) is decided
from the merge tree of both and memoised.  The result is exactly the one that
merging the lowest rank first gives.

Words repeat, so bounded memos keep the ids of pretokens and of the chunks between
white space.  The split into chunks holds for patterns whose pretokens contain no
white space but one leading space, as that of the public vocabulary.

Defined results: null text counts as empty; an empty text has no ids and decodes
to nothing.  Repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common

NONE = -1
#: Strings kept in each of a worker's two memos, and the longest one that is kept.
MEMO_SIZE, MEMO_CHARS = 300_000, 48
#: Unicode's White_Space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No pretoken spans two of these: white space as the pattern cuts it, and all that stands between.
CHUNKS = rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pretoken_pattern(pattern: str) -> str:
    r"""The pattern for Python's `regex`, whose own \s also takes U+001C to U+001F."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Codec(dict):
    """Encodes and decodes by ranks; as a dict it is the memo from chunk to its ids (little-endian, 32 bits each)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        super().__init__()
        self.ranks = ranks
        self.find = regex.compile(pretoken_pattern(pattern)).findall
        self.chunks = re.compile(CHUNKS).findall
        self.pieces: dict[str, bytes] = {}
        self.size = max(ranks.values(), default=-1) + 1
        self.token = [b""] * self.size
        self.length = [0] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
            self.length[rank] = len(token)
        self.shorter = [NONE] * self.size  # longest token that is a proper prefix
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        for rank, token in enumerate(self.token):
            for n in range(len(token) - 1, 0, -1):
                if (prefix := ranks.get(token[:n], NONE)) != NONE:
                    self.shorter[rank] = prefix
                    break
        for rank, token in enumerate(self.token):
            left = self.shorter[rank]
            while left != NONE:
                right = ranks.get(token[len(self.token[left]) :], NONE)
                if right != NONE and left < rank and right < rank and self._border_holds(left, right):
                    self.merged[left, right] = rank
                    self.halves[rank] = (left, right)
                    break
                left = self.shorter[left]

    def _border_holds(self, left: int, right: int) -> bool:
        """Merging by rank never joins bytes across the border of the two tokens.

        Both are taken apart, the later merge first; at each step the tokens that
        touch the border must not merge before the part that was undone.
        """
        merged, halves = self.merged, self.halves
        before = self.size + 1
        while True:
            if merged.get((left, right), before) < before:
                return False
            if left > right:
                before, left = left, halves[left][1]
                if left == before:
                    before, right = right + 1, halves[right][0]
                    if right + 1 == before:
                        return True
            else:
                before, right = right + 1, halves[right][0]
                if right + 1 == before:
                    before, left = left, halves[left][1]
                    if left == before:
                        return True

    def neighbours(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= 1_000_000:
                self.fits.clear()
            known = self.fits[left, right] = self._border_holds(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest = [NONE] * n
        length = [0] * n
        for end, (size, rank) in self.automaton.iter(piece.decode("latin-1")):
            start = end - size + 1
            if size > length[start]:
                length[start], longest[start] = size, rank
        open_ = bytearray(b"\x01") * (n + 1)
        sizes, shorter, fits = self.length, self.shorter, self.fits
        out: list[int] = []
        at, candidate, last = 0, longest[0], NONE
        while at < n:
            while candidate != NONE:
                end = at + sizes[candidate]
                if open_[end]:
                    if last == NONE:
                        break
                    fit = fits.get((last, candidate))
                    if fit or fit is None and self.neighbours(last, candidate):
                        break
                candidate = shorter[candidate]
            if candidate != NONE:
                out.append(candidate)
                at, last = end, candidate
                candidate = longest[at] if at < n else NONE
            else:
                if last == NONE:
                    raise ValueError("the vocabulary lacks some bytes")
                open_[at] = 0
                candidate = out.pop()
                at -= sizes[candidate]
                last = out[-1] if out else NONE
        return out

    def _piece(self, pretoken: str) -> bytes:
        ids = self.pieces.get(pretoken)
        if ids is None:
            ids = array("I", self.encode_piece(pretoken.encode("utf-8", "surrogatepass"))).tobytes()
            if len(pretoken) <= MEMO_CHARS:
                if len(self.pieces) >= MEMO_SIZE:
                    self.pieces.clear()
                self.pieces[pretoken] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join(map(self._piece, self.find(chunk)))
        if len(chunk) <= MEMO_CHARS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian, 32 bits each."""
        return b"".join(map(self.__getitem__, self.chunks(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec a worker and vocabulary."""
    return Codec(read_ranks(path), pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian 32 bits each) and decoded (binary) of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            at, _ = common.buffers(batch.column("text"))
            for a, b in common.blocks(at):
                ids = [own.encode(t) for t in batch.column("text").slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(a, b - a),
                    "ids": pa.array(ids, pa.binary()),
                    "decoded": pa.array([own.decode(x) for x in ids], pa.binary()),
                })

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    return common.in_batches(rows, work, "doc_id long, ids binary, decoded binary")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = round_trip(common.read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
