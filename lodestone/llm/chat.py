"""Chat formatting by prefix-target expansion (operator 3).

Every assistant turn is an example of its own: its context is all turns before
it, and only its reply is trained on.  `format_turns` makes one row a turn (a piece
of template text with its offset); from the ordered pieces every example is written
out whole, part by part, so that no more than a part and the turn at hand is held.
Reading the examples back gives the query's columns and checks that each
context is the example before it with the turns between, and each target the reply.

Template: `<|role|>` + escaped text + `<|end|>` + newline.  Inside roles and texts
`\\` becomes `\\\\`, `<|` becomes `<\\|` and `|>` becomes `|\\>`, so no text can contain a control string,
and reading back undoes both exactly.  Strings of other templates (`</s>`,
`[INST]`) have no meaning here and stay as they are.

Defined results: null text or role is empty; turns are ordered by (turn, role,
text) with null turns first, so repeated rows follow each other and are kept; a null conv_id is a
conversation; turns after the last assistant turn (all, where there is none) are no
example's and are written after the examples; extra columns are ignored; an empty table gives only the query's
conversation -1.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import tempfile
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import common

END = "<|end|>\n"
#: Most bytes of an example that one row holds, and of a conversation's text in memory (the rest is in a temporary file).
PART, HELD = 1 << 20, 1 << 24
_EXAMPLE = {"conv_id": pa.int64(), "example": pa.int64(), "part": pa.int64(), "text": pa.string(), "target_begin": pa.int64(), "target_end": pa.int64()}
#: A turn that tries to close the turn early in another template.
TRICKY = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    plain = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(plain, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def unescape(text: str) -> str:
    """Undo `escape`."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position, piece, begin and end (code points, in the conversation's text), target_begin, target_end, example.

    target_begin and target_end bound what is trained on, relative to the
    conversation's text, and are null outside assistant turns; example numbers
    the assistant turns of a conversation.  Example e's context and target are the
    pieces up to and including the one that bears its number.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    head = F.concat(F.lit("<|"), escape(F.col("role")), F.lit("|>"))
    rows = turns.select("*", head.alias("head"), escape(F.col("text")).alias("body"))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END))).withColumn("n", F.char_length("piece").cast("long"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    trained = F.col("role") == "assistant"
    placed = rows.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("position"), "piece",
        F.sum("n").over(running).alias("end"), F.col("n"), F.char_length("head").cast("long").alias("h"), F.char_length("body").cast("long").alias("b"),
        trained.alias("trained"), F.sum(trained.cast("long")).over(running).alias("count"),
    )
    begin = F.col("end") - F.col("n")
    return placed.select(
        "conv_id", "position", "piece", begin.alias("begin"), "end",
        F.when(F.col("trained"), begin + F.col("h")).alias("target_begin"),
        F.when(F.col("trained"), begin + F.col("h") + F.col("b")).alias("target_end"),
        F.when(F.col("trained"), F.col("count") - 1).alias("example"),
    )


def _rows(file: IO[bytes], begin: int, part: int) -> Iterator[str]:
    """The file's text from byte `begin` on, at most `part` bytes at a time; nothing for an empty rest."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    file.seek(begin)
    while data := file.read(part):
        if text := decoder.decode(data):
            yield text


def _examples(batches: Iterator[pa.RecordBatch], part: int = PART, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Every example written out whole, in parts; then the turns after a conversation's last example, as example null.

    Pieces come in order.  The conversation's text so far is kept in a file, in memory
    up to `held` bytes, and read again from its beginning for each example.
    """
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _EXAMPLE.values(), strict=True)], list(_EXAMPLE))

    def written(begin: int, example: int | None, target_begin: int | None, target_end: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal size
        for k, text in enumerate(_rows(file, begin, part)):
            rows.append((now, example, k, text, target_begin, target_end))
            size += len(text)
            if size >= part:
                yield out()
                rows.clear()
                size = 0

    file: IO[bytes] | None = None
    now, used = None, 0
    for batch in batches:
        for conv, piece, *target in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "example", "target_begin", "target_end")), strict=True):
            if file is None or conv != now:
                if file is not None:
                    yield from written(used, None, None, None)
                    file.close()
                file, now, used = tempfile.SpooledTemporaryFile(max_size=held), conv, 0
            file.seek(0, 2)
            file.write(piece.encode())
            if target[0] is not None:
                used = file.tell()
                yield from written(0, *target)
    if file is not None:
        yield from written(used, None, None, None)
        file.close()
    if rows:
        yield out()


def _in_order(formatted: DataFrame) -> DataFrame:
    rows = formatted.select("conv_id", "position", "piece", "example", "target_begin", "target_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def expand(formatted: DataFrame) -> DataFrame:
    """conv_id, example, part, text, target_begin, target_end: every example written out.

    An example of more than PART bytes has several parts; its text is theirs in order,
    and the target's bounds are relative to that text.
    """
    types = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in _EXAMPLE.items())
    return common.in_batches(_in_order(formatted), _examples, types).filter("example is not null")


class _Digest:
    """What the query returns of one conversation, from its examples fed part by part."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.loss, self.examples, self.expanded = conv_id, 0, 0, 0
        self.trained = hashlib.sha256()
        # turns of the example before, and their hash; all turns of an example begin anew
        self.known, self.known_hash = 0, hashlib.sha256().digest()
        self.begin_text()

    def begin_text(self) -> None:
        self.all, self.turns, self.chars, self.rest, self.scanned, self.target, self.last = hashlib.sha256(), 0, 0, "", 0, [], None

    def fail(self, what: str) -> None:
        raise ValueError(f"conversation {self.conv_id}, example {self.examples}: {what}")

    def feed(self, text: str, target_begin: int | None, target_end: int | None) -> None:
        if target_begin is not None:
            self.target.append(text[max(0, target_begin - self.chars) : max(0, target_end - self.chars)])
        self.chars += len(text)
        buffer, at = self.rest + text, 0
        while (head := buffer.find("|>", at + 2)) >= 0:
            if not buffer.startswith("<|", at):
                self.fail("no turn where one should begin")
            end = buffer.find(END, max(head + 2, self.scanned))
            if end < 0:
                self.scanned = max(head + 2, len(buffer) - len(END))
                break
            self.turn(unescape(buffer[at + 2 : head]), unescape(buffer[head + 2 : end]))
            at, self.scanned = end + len(END), 0
        self.rest, self.scanned = buffer[at:], max(0, self.scanned - at)

    def turn(self, role: str, text: str) -> None:
        for part in (role, "\n", text, "\n"):
            self.all.update(part.encode("utf-8", "surrogatepass"))
        self.turns, self.last = self.turns + 1, (role, text)
        if self.turns == self.known and self.all.digest() != self.known_hash:
            self.fail("its context is not the example before")

    def end_text(self, example: bool) -> None:
        if self.rest:
            self.fail("ends within a turn")
        if not example:
            return
        target = unescape("".join(self.target))
        if self.turns <= self.known or self.last != ("assistant", target):
            self.fail("its target is not the reply after its context")
        self.loss += len(target)
        self.trained.update(target.encode("utf-8", "surrogatepass"))
        self.examples += 1
        self.expanded += self.chars
        self.known, self.known_hash = self.turns, self.all.digest()

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.trained.hexdigest(), self.chars, self.examples, self.expanded)


_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "expanded_chars"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of `_examples` read back, a row a conversation; held are running hashes and the turn being read."""
    types = [pa.string() if n.endswith("sha256") else pa.int64() for n in _COLUMNS]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _COLUMNS)

    now: _Digest | None = None
    open_: int | None = None
    for batch in batches:
        done = []
        for conv, example, part, *text in zip(*(batch.column(c).to_pylist() for c in _EXAMPLE), strict=True):
            if now is None or conv != now.conv_id:
                if now is not None:
                    now.end_text(open_ is not None)
                    done.append(now.row())
                now = _Digest(conv)
            elif part == 0:
                now.end_text(open_ is not None)
                if example is not None:
                    now.begin_text()
            open_ = example
            now.feed(*text)
        if done:
            yield out(done)
    if now is not None:
        now.end_text(open_ is not None)
        yield out([now.row()])


def _examples_read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _digests(_examples(batches))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what writing all its examples and reading them back gives: turns, trained text and sizes."""
    return common.in_batches(_in_order(formatted), _examples_read_back, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in _COLUMNS))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = spark.sql(f"select -1L conv_id, id turn, if(id = 0, 'user', 'assistant') role, '{TRICKY}' text from range(2)")
    return read_back(format_turns(own.unionByName(tricky)))
