"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the text before and after a turn and whether its body carries loss.
Control strings inside bodies are escaped reversibly, so the formatted text can be read back. Turns are
grouped by conversation and sorted by the engine; a task streams through them and holds one turn at a
time, however long a conversation is.

Defined results: a null text counts as empty; turns are taken by (turn, role, text), nulls first; a null
or unknown role is written as its name under the template's ``other`` frame, without loss, and makes the
order invalid; repeated rows are turns each; an empty table gives an empty result; further columns are
ignored. The machine only marks a conversation (valid, problem): nothing is dropped.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, saved


@dataclass(frozen=True)
class Frame:
    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    """frames by role; other is for any other role, its name written in place of {}; moves: roles that may follow a state."""

    frames: dict[str, Frame] = field(default_factory=lambda: {"system": Frame("### System: ", " </turn>\n", False), "user": Frame("### User: ", " </turn>\n", False), "assistant": Frame("### Assistant: ", " </turn>\n", True)})
    other: Frame = Frame("### Role {}: ", " </turn>\n", False)
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    finals: tuple[str, ...] = ("assistant",)

    def escaped(self, text: str) -> str:
        """A backslash before each backslash, each ### and each </turn>: no control string stays bare."""
        return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text)

    def plain(self, text: str) -> str:
        return re.sub(r"\\(\\|###|</turn>)", lambda m: m[1], text)

    def segments(self, role: str | None, text: str) -> list[tuple[str, bool]]:
        """(text, loss) of one turn: its frame and its escaped body."""
        frame = self.frames.get(role)
        if frame is None:
            name = "!" if role is None else "=" + self.escaped(role).replace(":", "\\:")
            frame = Frame(self.other.before.replace("{}", name), self.other.after, self.other.loss)
        return [(frame.before, False), (self.escaped(text), frame.loss), (frame.after, False)]

    def parsed(self, turn: str) -> tuple[str | None, str]:
        """Role and text of one formatted turn."""
        for role, f in self.frames.items():
            if turn.startswith(f.before) and turn.endswith(f.after):
                return role, self.plain(turn[len(f.before) : -len(f.after)])
        m = re.match(r"### Role (!|=(?:\\.|[^:\\])*): ", turn, re.S)
        if not m or not turn.endswith(self.other.after):
            raise ValueError(f"not a formatted turn: {turn[:80]!r}")
        role = None if m[1] == "!" else self.plain(m[1][1:].replace("\\:", ":"))
        return role, self.plain(turn[m.end() : -len(self.other.after)])


class Machine:
    """Follows the roles of one conversation."""

    def __init__(self, template: Template):
        self.template, self.state, self.problem = template, "start", None

    def step(self, role: str | None) -> None:
        if self.problem is None and role not in self.template.moves.get(self.state, ()):
            self.problem = f"{role} after {self.state}"
        self.state = role or "?"

    def ended(self) -> str | None:
        return self.problem or (None if self.state in self.template.finals else f"ends with {self.state}")


def _by_conversation(df: DataFrame, *order: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "conv_id").sortWithinPartitions("conv_id", *order)


def _formatted(template: Template):
    def run(batches):
        conv, n, machine, first = None, 0, Machine(template), True
        for batch in batches:
            rows = []
            for c, role, text in zip(*(column(batch, k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if first or c != conv:
                    conv, n, machine, first = c, 0, Machine(template), False
                machine.step(role)
                rows.append((c, n, [{"text": t, "loss": x} for t, x in template.segments(role, text or "")], machine.problem))
                n += 1
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "turn_no", "segments", "problem"])

    return run


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn in conversation order: conv_id, turn_no (from 0), segments (text and loss), problem (the machine's, so far)."""
    rows = conversations.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    return _by_conversation(rows, "turn", "role", "text").mapInArrow(_formatted(template or Template()), "conv_id long, turn_no long, segments array<struct<text:string,loss:boolean>>, problem string")


class Digest:
    def __init__(self, template: Template):
        self.template, self.machine = template, Machine(template)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.loss_segments = 0

    def add(self, segments: list[dict]) -> None:
        role, text = self.template.parsed("".join(s["text"] for s in segments))
        self.machine.step(role)
        self.turns.update(f"{role or ''}\n{text}\n".encode())
        for s in segments:
            self.formatted_chars += len(s["text"])
            if s["loss"]:
                plain = self.template.plain(s["text"])
                self.loss.update(plain.encode())
                self.loss_chars += len(plain)
                self.loss_segments += 1
        self.n_turns += 1

    def row(self, conv) -> tuple:
        problem = self.machine.ended()
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, problem is None, problem


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, problem string"


def _read(template: Template):
    def table(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in READ.split(", ")])

    def run(batches):
        conv, digest = None, None
        for batch in batches:
            done = []
            for c, segments in zip(column(batch, "conv_id").to_pylist(), column(batch, "segments").to_pylist(), strict=True):
                if digest is None or c != conv:
                    if digest:
                        done.append(digest.row(conv))
                    conv, digest = c, Digest(template)
                digest.add(segments)
            if done:
                yield table(done)
        if digest:
            yield table([digest.row(conv)])

    return run


def read_back(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Parses formatted turns again; one row per conversation with the digests of what was read."""
    return _by_conversation(turns.select("conv_id", "turn_no", "segments"), "turn_no").mapInArrow(_read(template or Template()), READ)


def report(conversations: DataFrame) -> DataFrame:
    """The contract's digest, read back from the written output; conversation -7 is added."""
    spark = conversations.sparkSession
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(more)
    return read_back(saved(formatted(rows), "formatted"))
