"""Chat formatting with a grammar round trip.

A turn becomes one frame of the template below. A deterministic parser reads the frame
back; where the turn it recovers differs from the source, because a text holds control
strings, the conflicting text is escaped by a backslash inside each of them and parsed
again until both are identical. The parser removes one backslash from each escaped control
string, so texts that hold escaped forms themselves come back as they were.

* user: ``[INST] text [/INST]``
* assistant: ``<s> text </s>``, its text is under the loss mask
* any other role: ``<<SYS>>role<newline>text<</SYS>>``

Null texts and roles are empty ones. Turns are ordered by turn number (null first); equal
numbers by their frames, so repeated turns all stay, in a fixed order. A null conversation
id is a conversation of its own. No rows give no rows.

A conversation's rows are never gathered in memory: they are rendered one by one, dealt by
conversation, sorted, and read as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

CONTROL = re.compile(r"\[/?INST\]|<</?SYS>>|</?s>")
_PLAIN_OR_ESCAPED = re.compile(r"([\[<])(\\*)(/?INST\]|</?SYS>>|/?s>)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|</?SYS>>|/?s>)")
_CLOSES = {"[INST]": "[/INST]", "<s>": "</s>", "<<SYS>>": "<</SYS>>"}


class Conflict(ValueError):
    """Text that the template's grammar does not allow."""


def escape(text: str) -> str:
    """One backslash more inside every control string, escaped or not."""
    return _PLAIN_OR_ESCAPED.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    """One backslash less inside every escaped control string."""
    return _ESCAPED.sub(r"\1\2\3", text)


def _role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


def frame(role: str, body: str) -> tuple[str, int]:
    """A turn's text in the template, and where its body begins."""
    if role == "user":
        head, tail = "[INST] ", " [/INST]"
    elif role == "assistant":
        head, tail = "<s> ", " </s>"
    else:
        head, tail = f"<<SYS>>{_role_line(role)}\n", "<</SYS>>"
    return head + body + tail, len(head)


class Parser:
    """Reads formatted text piece by piece and gives the finished turns."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> list[Turn]:
        text, turns, at = self.rest + text, [], 0
        while at < len(text):
            opening = CONTROL.match(text, at)
            if opening is None or opening[0] not in _CLOSES:
                raise Conflict(f"no turn begins at {at}")
            closing = CONTROL.search(text, opening.end())
            if closing is None:
                break
            if closing[0] != _CLOSES[opening[0]]:
                raise Conflict(f"{closing[0]} inside a turn of {opening[0]}")
            turns.append(self._turn(opening[0], text[opening.end() : closing.start()]))
            at = closing.end()
        self.rest = text[at:]
        return turns

    def close(self) -> None:
        if self.rest:
            raise Conflict("the last turn does not end")

    @staticmethod
    def _turn(kind: str, inner: str) -> Turn:
        if kind == "<<SYS>>":
            line, feed, body = inner.partition("\n")
            if not feed:
                raise Conflict("a role line does not end")
            return _role_of(line), unescape(body)
        if not (len(inner) >= 2 and inner[0] == inner[-1] == " "):
            raise Conflict("a text is not set off by spaces")
        return ("user" if kind == "[INST]" else "assistant"), unescape(inner[1:-1])


def _reads_back(formatted: str, turn: Turn) -> bool:
    parser = Parser()
    try:
        turns = parser.feed(formatted)
        parser.close()
    except Conflict:
        return False
    return turns == [turn]


def render(role: str, text: str) -> tuple[str, int, int]:
    """A frame that parses to exactly this turn, and its body's place in it."""
    body = text
    for _ in range(2):
        formatted, start = frame(role, body)
        if _reads_back(formatted, (role, text)):
            return formatted, start, start + len(body)
        body = escape(text)
    raise Conflict("an escaped turn does not read back")


SEGMENTS = "segment string, loss_start int, loss_end int"


def format_turns(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Per turn: ``conv_id, turn, segment, loss_start, loss_end`` (null outside the mask).

    A conversation's formatted text is its segments in order of ``turn, segment``.
    """
    narrow = df.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    types = dict(narrow.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                formatted, start, end = render(r, t)
                made.append((formatted, start, end) if r == "assistant" else (formatted, None, None))
            segment, start, end = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(segment, pa.string()),
                    pa.array(start, pa.int32()),
                    pa.array(end, pa.int32()),
                ],
                names=["conv_id", "turn", "segment", "loss_start", "loss_end"],
            )

    return narrow.mapInArrow(run, f"conv_id {types['conv_id']}, turn {types['turn']}, {SEGMENTS}")


class _Digest:
    """What is read back of one conversation, kept as running digests."""

    def __init__(self):
        self.parser = Parser()
        self.turns, self.loss_chars, self.chars = 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        self.chars += len(segment)
        for role, text in self.parser.feed(segment):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{text}\n".encode("utf-8"))
        if start is not None:
            loss = unescape(segment[start:end])
            self.loss_chars += len(loss)
            self.loss_hash.update(loss.encode("utf-8"))

    def result(self) -> tuple:
        self.parser.close()
        return self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, parsed from its formatted text:
    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    kind = dict(segments.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, out = None, None, []
        arrow = None
        for batch in batches:
            arrow = batch.schema.field("conv_id").type
            for k, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if digest is None or k != key:
                    if digest is not None:
                        out.append((key, *digest.result()))
                    key, digest = k, _Digest()
                digest.add(segment, start, end)
            if out:
                yield _digest_batch(out, arrow)
                out = []
        if digest is not None:
            yield _digest_batch([(key, *digest.result())], arrow)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return dealt.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long",
    )


def _digest_batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
