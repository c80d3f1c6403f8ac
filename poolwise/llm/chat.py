"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_chat`` emits text segments, three for each turn: head, body, tail. A segment says whether its
text bears loss. Control strings inside texts are escaped: the template's escape sign goes before every
character that starts a control string, so no text can end a turn or open another, and reading back
gives the text exactly.

Turns are partitioned by conversation, sorted by Spark and streamed; a task holds one turn, however long
the conversation. The digests are sha256 over a whole conversation, which is sequential by definition.

Defined results: a null text is empty; a null role is the empty role; roles that the template does not
declare are written with a mark, bear no loss and break the turn order; rows of equal turn follow in
the order of role, then text, and nulls come first; repeated rows are turns of their own, which break the turn order; a null
conv_id is a conversation; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, slices

SEGMENTS = "conv_id long, segment long, text string, loss boolean, legal boolean"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
)


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles bear loss, and which role may follow which."""

    open: str
    named: str
    close: str
    escape: str
    names: tuple[tuple[str, str], ...]
    unknown: str
    loss_roles: frozenset[str]
    start: frozenset[str]
    after: tuple[tuple[str, frozenset[str]], ...]
    final: frozenset[str]

    @property
    def control(self) -> str:
        """Characters that a text may hold only after the escape sign."""
        return self.escape + self.open[0] + self.close[0]

    def escaped(self, text: str, more: str = "") -> str:
        return re.sub("[" + re.escape(self.control + more) + "]", lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        return re.sub(re.escape(self.escape) + "(.)", r"\1", text, flags=re.S)

    def head(self, role: str) -> str:
        name = dict(self.names).get(role)
        shown = self.unknown + self.escaped(role, self.named[0]) if name is None else name
        return self.open + shown + self.named

    def pattern(self) -> re.Pattern:
        """A formatted turn: its role as shown, its escaped text."""
        sign = re.escape(self.escape)

        def free(stop: str) -> str:
            plain = f"[^{sign}{re.escape(stop)}]*"
            return f"({plain}(?:{sign}.{plain})*)"

        return re.compile(re.escape(self.open) + free(self.named[0]) + re.escape(self.named) + free(self.close[0]) + re.escape(self.close), re.S)

    def role_of(self, shown: str) -> str:
        if shown.startswith(self.unknown):
            return self.unescaped(shown[len(self.unknown) :])
        return {name: role for role, name in self.names}[shown]


HEADINGS = Template(
    open="### ",
    named=": ",
    close="</turn>\n",
    escape="\\",
    names=(("system", "System"), ("user", "User"), ("assistant", "Assistant")),
    unknown="?",
    loss_roles=frozenset({"assistant"}),
    start=frozenset({"system", "user"}),
    after=(
        ("system", frozenset({"user"})),
        ("user", frozenset({"assistant"})),
        ("assistant", frozenset({"user"})),
    ),
    final=frozenset({"assistant"}),
)


class TurnOrder:
    """The state machine: its state is the last role, None before the first turn."""

    def __init__(self, template: Template):
        self.start, self.after = template.start, dict(template.after)
        self.last: str | None = None

    def step(self, role: str) -> bool:
        allowed = self.start if self.last is None else self.after.get(self.last, frozenset())
        self.last = role
        return role in allowed


def in_order(df: DataFrame, *columns) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *columns)


def format_chat(conversations: DataFrame, template: Template = HEADINGS) -> DataFrame:
    """Segments of every conversation: conv_id, segment (from 0), text, loss, legal."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    names, types = [f.split()[0] for f in SEGMENTS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, order, at = (), TurnOrder(template), 0
        for batch in slices(batches, "text"):
            cells = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if (conv,) != current:
                    current, order, at = (conv,), TurnOrder(template), 0
                legal = order.step(role)
                loss = role in template.loss_roles
                for part, bears in ((template.head(role), False), (template.escaped(text), loss), (template.close, False)):
                    cells.append((conv, at, part, bears, legal))
                    at += 1
            yield arrow_batch(names, types, list(zip(*cells, strict=True)))

    return in_order(rows, "turn", "role", "text").mapInArrow(run, SEGMENTS)


class Reader:
    """Reads one conversation's segments back, from their text and loss flags alone."""

    def __init__(self, template: Template, pattern: re.Pattern):
        self.template, self.pattern = template, pattern
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.order, self.legal = TurnOrder(template), True
        self.parts: list[str] = []

    def feed(self, text: str, loss: bool) -> None:
        self.parts.append(text)
        self.chars += len(text)
        if loss:
            plain = self.template.unescaped(text)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
        if text.endswith(self.template.close) and (m := self.pattern.fullmatch("".join(self.parts))):
            role, body = self.template.role_of(m[1]), self.template.unescaped(m[2])
            self.turns.update(f"{role}\n{body}\n".encode())
            self.n_turns += 1
            self.legal &= self.order.step(role)
            self.parts = []

    def result(self) -> tuple:
        if self.parts:
            raise ValueError("the segments end inside a turn")
        valid = self.legal and self.order.last in self.template.final
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, valid


def read_chat(segments: DataFrame, template: Template = HEADINGS) -> DataFrame:
    """One row per conversation, read back from its segments."""
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, current, reader = template.pattern(), (), None
        for batch in slices(batches, "text"):
            rows = []
            for conv, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss")), strict=True):
                if (conv,) != current:
                    if reader is not None:
                        rows.append((*current, *reader.result()))
                    current, reader = (conv,), Reader(template, pattern)
                reader.feed(text, loss)
            if rows:
                yield arrow_batch(names, types, list(zip(*rows, strict=True)))
        if reader is not None:
            yield arrow_batch(names, types, [[x] for x in (*current, *reader.result())])

    return in_order(segments, "segment").mapInArrow(run, DIGESTS)
