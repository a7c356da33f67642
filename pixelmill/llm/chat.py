"""Chat formatting: a finite-state machine over roles checks the order of turns and emits text segments with loss flags
from a declarative template; `read_back` parses the segments again.

Turns are dealt by conversation and sorted within partitions (Spark spills), then streamed: a conversation of any
length needs the memory of one turn.

Defined cases: null texts and roles are empty; turns that tie are ordered by role and text; a role that the template
does not know is written with its name; a turn in a wrong place is still formatted, with ok = false; conversations
without an id are one conversation; empty tables give empty results; extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: Opening and closing marker of each known role.
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    #: Around the name of another role, and the closing marker of its turns.
    other: tuple[str, str, str] = ("<|", "|>", "<|/|>")
    loss: frozenset[str] = frozenset({"assistant"})
    #: state -> role -> next state; what is missing is out of order.
    order: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: frozenset[str] = frozenset({"answered"})

    def controls(self) -> list[str]:
        return sorted({m for pair in self.roles.values() for m in pair} | set(self.other), key=lambda m: (-len(m), m))


class Writer:
    def __init__(self, template: Template):
        self.t = template
        self.control = re.compile("(?=" + "|".join(map(re.escape, template.controls())) + ")(.)", re.S)

    def escape(self, text: str) -> str:
        r"""Doubles backslashes and puts one behind the first character of each control string; `unescape` undoes it."""
        return self.control.sub(r"\1\\", text.replace("\\", "\\\\"))

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        opening, closing = self.t.roles.get(role) or (self.t.other[0] + self.escape(role) + self.t.other[1], self.t.other[2])
        return opening, self.escape(text), closing


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Reader:
    """Parses formatted text that comes in parts; holds no more than the turn that is not yet complete."""

    def __init__(self, template: Template):
        self.t, self.buffer = template, ""

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        self.buffer += part
        while self.buffer:
            for role, (opening, closing) in self.t.roles.items():
                if self.buffer.startswith(opening):
                    break
            else:
                before, after, closing = self.t.other
                stop = self.buffer.find(after, len(before)) if self.buffer.startswith(before) else -1
                if stop < 0:
                    return
                role, opening = unescape(self.buffer[len(before):stop]), self.buffer[:stop + len(after)]
            end = self.buffer.find(closing, len(opening))
            if end < 0:
                return
            text, self.buffer = self.buffer[len(opening):end], self.buffer[end + len(closing):]
            yield role, unescape(text)


def segments(conversations: DataFrame, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position (of the turn, from 0), segment (0 opening, 1 text, 2 closing), text, loss, ok.  Rows of a
    conversation follow each other, in order, in one partition."""
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "position", "segment", "text", "loss", "ok"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, current, position, state = Writer(template), object(), 0, "start"
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != current:
                    current, position, state = conv, 0, "start"
                after = template.order.get(state, {}).get(role)
                for i, part in enumerate(writer.turn(role, text)):
                    for column, v in zip(out, (conv, position, i, part, i == 1 and role in template.loss, after is not None)):
                        column.append(v)
                state, position = after or state, position + 1
            kinds = [batch.column("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kind}, position long, segment int, text string, loss boolean, ok boolean")


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, ordered of the output of `segments`."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "ordered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, reader, kinds = none, None, None

        def fresh() -> None:
            nonlocal reader, turns, loss, n, lost, chars, ordered, last
            reader, turns, loss, n, lost, chars, ordered, last = Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, "start"

        turns = loss = last = None
        n = lost = chars = 0
        ordered = True

        def done() -> tuple:
            if reader.buffer:
                raise ValueError("formatted text does not end with a whole turn")
            return current, n, turns.hexdigest(), lost, loss.hexdigest(), chars, ordered and last in template.final

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            kinds = [batch.column("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            out = []
            for conv, part, masked, ok in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "ok"))):
                if current is none or conv != current:
                    if current is not none:
                        out.append(done())
                    current = conv
                    fresh()
                chars += len(part)
                ordered &= ok
                if masked:
                    text = unescape(part)
                    lost += len(text)
                    loss.update(text.encode())
                for role, text in reader.feed(part):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                    last = template.order.get(last, {}).get(role, last)
            if out:
                yield batch_of(out)
        if current is not none:
            yield batch_of([done()])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, ordered boolean")
