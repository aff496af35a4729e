"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

Turns of a conversation are read in order; the machine checks each turn's role
against the state the last turn led to and emits text segments with a loss
flag. Rows are dealt by conversation, sorted, and streamed: no conversation is
ever held as a whole, so a very long one costs time in its task, not memory.

Defined results: a null text or role is the empty text; turns of equal number
are ordered by role, then text; null turn numbers come first; repeated rows are
turns of their own; rows without a conversation id form one conversation with a
null id; an order the machine rejects is formatted all the same and counted in
``order_errors``; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers per role, and the machine: state -> {role: next state}."""

    opening: str = "<s>"
    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("[OUT]", "</s>", loss=True),
    })
    #: Any other role: its name between the first two, the text between the last two.
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    machine: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    })
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        marks = {self.opening, *self.other}
        for role in self.roles.values():
            marks |= {role.before, role.after}
        return sorted(marks, key=lambda m: (-len(m), m))


class Escape:
    """Breaks control strings in a text, reversibly.

    The first character of a control string - or of a beginning of one at the
    end of the text, which a following marker could complete - is written as a
    backslash and a code letter; a backslash is doubled.
    """

    def __init__(self, controls: list[str]):
        if any(not c or c[0] == "\\" for c in controls):
            raise ValueError("a control string is empty or starts with a backslash")
        first = sorted({c[0] for c in controls})
        self.code = {c: chr(ord("a") + i) for i, c in enumerate(first)} | {"\\": "\\"}
        self.plain = {v: k for k, v in self.code.items()}
        tails = []
        for c in controls:
            starts = "|".join(re.escape(c[1:k]) for k in range(len(c) - 1, 1, -1))
            tails.append(f"{re.escape(c[0])}(?={re.escape(c[1:])}|(?:{starts})?\\Z)")
        self.find = re.compile("\\\\|" + "|".join(tails))
        self.back = re.compile(r"\\(.)", re.S)

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: "\\" + self.code[m[0]], text)

    def unescape(self, text: str) -> str:
        return self.back.sub(lambda m: self.plain[m[1]], text)


SEGMENTS = "conv_id long, position long, state string, order_error boolean, segments array<struct<text:string,loss:boolean>>"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("position", pa.int64()), ("state", pa.string()), ("order_error", pa.bool_()),
    ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))])
STEP = 512


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn, in order within its partition: the segments it adds to its conversation's text."""
    t = template or Template()

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        esc, now, state, position = Escape(t.controls()), object(), "start", 0
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                out = []
                for row in batch.slice(at, STEP).to_pylist():
                    name, text = row["role"] or "", row["text"] or ""
                    segments = []
                    if row["conv_id"] != now:
                        now, state, position = row["conv_id"], "start", 0
                        segments.append((t.opening, False))
                    step = t.machine.get(state, {}).get(name)
                    role = t.roles.get(name)
                    if role:
                        segments.append((role.before, False))
                    else:
                        segments += [(t.other[0], False), (esc.escape(name), False), (t.other[1], False)]
                    segments.append((esc.escape(text), bool(role and role.loss)))
                    segments.append((role.after if role else t.other[2], False))
                    error, state = step is None, step or (name if name in t.machine else state)
                    out.append({"conv_id": now, "position": position, "state": state, "order_error": error,
                                "segments": [{"text": x, "loss": y} for x, y in segments]})
                    position += 1
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    # A spare constant keeps null ids apart from the first "no conversation yet".
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                        F.col("role").cast("string"), F.col("text").cast("string"))
    return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .mapInArrow(emit, SEGMENTS))


READ_BACK = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long, order_errors long, complete boolean")


class Reader:
    """Reads one conversation's marked text and loss mask, fed in pieces cut anywhere.

    Turns are found by the control strings alone. A mark is taken only when no
    longer one could still follow from the next piece; what is held is the
    text since the last mark, so at most one turn.
    """

    def __init__(self, template: Template, esc: Escape, scan: re.Pattern):
        self.t, self.esc, self.scan = template, esc, scan
        self.longest = max(map(len, template.controls()))
        self.text, self.mask, self.at = "", [], 0  # mask: (end, loss) of the runs of the held text
        self.marks: list[str] = []  # of the turn being read
        self.fields: list[str] = []
        self.opened, self.state = False, "start"
        self.n = self.loss_chars = self.chars = self.errors = 0
        self.turns, self.loss, self.lossy = hashlib.sha256(), hashlib.sha256(), []

    def feed(self, text: str, loss: bool) -> None:
        if text:
            self.text += text
            if self.mask and self.mask[-1][1] == loss:
                self.mask.pop()
            self.mask.append((len(self.text), loss))
            self.chars += len(text)

    def _masked(self, start: int, end: int) -> str:
        out, begin = [], 0
        for stop, loss in self.mask:
            if loss and begin < end and stop > start:
                out.append(self.text[max(begin, start) : min(stop, end)])
            begin = stop
        return "".join(out)

    def read(self, last: bool = False) -> None:
        """Takes every mark that is certain; all of them at the end."""
        done = 0
        while (m := self.scan.search(self.text, self.at)) and (last or m.start() + self.longest <= len(self.text)):
            self._mark(m[0], done, m.start())
            if self._masked(m.start(), m.end()):
                raise ValueError("a mark is under the loss mask")
            done = self.at = m.end()
        if done:
            self.text = self.text[done:]
            self.mask = [(stop - done, loss) for stop, loss in self.mask if stop > done]
        self.at = 0 if last else max(0, len(self.text) - self.longest)
        if last and (self.text or self.marks or not self.opened):
            raise ValueError("the text ends inside a turn")

    def _mark(self, mark: str, start: int, end: int) -> None:
        between = self.text[start:end]
        if not self.marks:
            starts = {r.before for r in self.t.roles.values()} | {self.t.other[0]}
            if between or (mark not in starts if self.opened else mark != self.t.opening):
                raise ValueError("marks do not match")
            if self.opened:
                self.marks.append(mark)
            self.opened = True
            return
        self.fields.append(self.esc.unescape(between))
        self.lossy.append(self._masked(start, end))
        self.marks.append(mark)
        named = next(((name, r.after) for name, r in self.t.roles.items() if r.before == self.marks[0]), None)
        wanted = [self.marks[0], named[1]] if named else list(self.t.other)
        if self.marks != wanted[: len(self.marks)]:
            raise ValueError("marks do not match")
        if len(self.marks) == len(wanted):
            self._turn(*((named[0], self.fields[0]) if named else self.fields))

    def _turn(self, role: str, said: str) -> None:
        self.turns.update(f"{role}\n{said}\n".encode())
        for x in self.lossy:
            plain = self.esc.unescape(x)
            self.loss.update(plain.encode())
            self.loss_chars += len(plain)
        step = self.t.machine.get(self.state, {}).get(role)
        self.errors += step is None
        self.state = step or (role if role in self.t.machine else self.state)
        self.n += 1
        self.marks, self.fields, self.lossy = [], [], []

    def result(self, conv_id: int | None) -> dict:
        self.read(last=True)
        return {"conv_id": conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
                "order_errors": self.errors, "complete": self.errors == 0 and self.state in self.t.final}


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of the conversations, parsed from the joined text and its loss mask alone.

    Of ``formatted`` only conv_id and segments (text, loss) are read. Rows of a
    conversation follow each other in their partition, as they come from
    ``format_conversations``; where its text is cut into rows and segments does
    not matter: a turn is what the marks say. Text that the template's marks
    do not parse raises an error.
    """
    t = template or Template()

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        esc, scan = Escape(t.controls()), re.compile("|".join(map(re.escape, t.controls())))
        now, reader = None, None
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                            ("formatted_chars", pa.int64()), ("order_errors", pa.int64()), ("complete", pa.bool_())])
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                out = []
                for row in batch.slice(at, STEP).to_pylist():
                    if reader is None or row["conv_id"] != now:
                        if reader:
                            out.append(reader.result(now))
                        now, reader = row["conv_id"], Reader(t, esc, scan)
                    for s in row["segments"]:
                        reader.feed(s["text"], s["loss"])
                    reader.read()
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if reader:
            yield pa.RecordBatch.from_pylist([reader.result(now)], schema=schema)

    return formatted.select("conv_id", "segments").mapInArrow(parse, READ_BACK)
