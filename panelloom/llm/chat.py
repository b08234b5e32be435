"""Chat formatting with a grammar round trip: every rendered turn is parsed again and escaped until it reads back.

Grammar of a formatted conversation: turn*, where a turn is an opening of its role, a body, and the first
closing of that role after it. In bodies and role names a backslash stands before a character that is
meant literally; what is parsed is unescaped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.batches import pieces


@dataclass(frozen=True)
class Template:
    """Openings and closings by role; roles of their own name have a marker that holds the name."""

    marks: tuple[tuple[str, str, str], ...] = (("user", "<s>[INST] ", " [/INST]"), ("system", "<<SYS>> ", " <</SYS>>"), ("assistant", " ", " </s>"))
    named: tuple[str, str, str] = ("<<ROLE:", ">> ", " <</ROLE>>")
    loss_roles: frozenset[str] = frozenset({"assistant"})

    def controls(self) -> list[str]:
        marks = [x.strip() for _, *both in self.marks for x in both] + [x.strip() for x in self.named]
        return sorted({c for m in marks for c in (m, *re.findall(r"<s>|\[INST\]", m)) if c}, key=lambda c: (-len(c), c))


#: how much of a text is escaped: nothing, control strings and backslashes, every character that a marker could hold
LEVELS = 3
UNESCAPE = re.compile(r"\\(.)", re.S)


class Grammar:
    def __init__(self, template: Template):
        self.template = template
        self.marks = {role: (o, c) for role, o, c in template.marks}
        self.order = sorted(template.marks, key=lambda m: -len(m[1]))
        self.marker = re.compile("|".join(map(re.escape, template.controls())))
        self.control = re.compile("|".join(map(re.escape, ["\\", *template.controls()])))
        self.any = re.compile("[" + re.escape("\\" + "".join(sorted({x for c in template.controls() for x in c}))) + " ]")

    def escape(self, text: str, level: int) -> str:
        if level == 0:
            return text
        if level == 1:
            return self.control.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}" if len(m[0]) > 1 else f"\\{m[0]}", text)
        return self.any.sub(lambda m: "\\" + m[0], text)

    def parse(self, data: str) -> tuple[list[tuple[str, str]], str]:
        """The turns (role, text) at the start of data, and what is left: a turn that has not ended yet."""
        turns, at = [], 0
        while at < len(data):
            role, start, close = None, -1, ""
            named, end_name, close_named = self.template.named
            if data.startswith(named, at):
                end = data.find(end_name, at)
                if end < 0:
                    break
                role, start, close = UNESCAPE.sub(r"\1", data[at + len(named) : end]), end + len(end_name), close_named
            else:
                for role, opening, close in self.order:
                    if data.startswith(opening, at):
                        start = at + len(opening)
                        break
                else:
                    break
            end = data.find(close, start)
            if end < 0:
                break
            turns.append((role, UNESCAPE.sub(r"\1", data[start:end])))
            at = end + len(close)
        return turns, data[at:]

    def render(self, role: str, text: str) -> tuple[str, int, int, int]:
        """The turn as text, the start and end of its body there, and the level of escaping that read back."""
        for level in range(LEVELS):
            if role in self.marks:
                opening, close = self.marks[role]
            else:
                opening, close = self.template.named[0] + self.escape(role, level) + self.template.named[1], self.template.named[2]
            body = self.escape(text, level)
            segment = opening + body + close
            if not (self.marker if level else self.control).search(body) and self.parse(segment) == ([(role, text)], ""):
                return segment, len(opening), len(opening) + len(body), level
        raise ValueError(f"no escaping reads back: {role!r}, {text[:80]!r}")


RENDERED = "conv_id long, turn long, role string, segment string, body_start long, body_end long, trained boolean, level int"


def render(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One formatted segment per row of turns; a conversation is its segments in the order of (turn, role, segment).

    body_start and body_end give the body in the segment; trained marks the bodies under the loss mask, and
    level how much had to be escaped. Null roles and texts are empty strings; a null turn comes first, a null
    conv_id is a conversation of its own; repeated rows are repeated turns. Other columns are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(template)
        for batch in pieces(batches):
            roles = [r or "" for r in batch.column(2).to_pylist()]
            found = [grammar.render(r, t or "") for r, t in zip(roles, batch.column(3).to_pylist())]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                 pa.array([r in template.loss_roles for r in roles], pa.bool_()), pa.array(columns[3], pa.int32())],
                ["conv_id", "turn", "role", "segment", "body_start", "body_end", "trained", "level"],
            )

    given = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(each, RENDERED)


def texts(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one string each, for conversations that fit in a row."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "segment")))
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["segment"]), "").alias("formatted"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(rendered: DataFrame, template: Template = Template()) -> DataFrame:
    """Per conversation what a reader of its formatted text gets: number of turns, digest of all roles and texts,
    length and digest of the text under the loss mask, and the formatted length.

    A digest of one conversation needs its text in order, so its segments meet in one task; that task
    reads them as a sorted stream and holds one unfinished turn, never a conversation. A text that does
    not end with a whole turn fails.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, key, state, out = Grammar(template), None, None, []

        def close():
            if state is not None:
                if state["rest"]:
                    raise ValueError(f"conversation {key} doesn't parse: {state['rest'][:80]!r}")
                out.append((key, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], [x.split()[0] for x in READ.split(", ")])

        for batch in batches:
            for now, segment, start, end, trained in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or now != key:
                    close()
                    key, state = now, {"turns": 0, "all": sha256(), "loss": sha256(), "chars": 0, "size": 0, "rest": ""}
                    if len(out) >= 10_000:
                        yield flush()
                        out = []
                found, state["rest"] = grammar.parse(state["rest"] + segment)
                for role, text in found:
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                if trained:
                    text = UNESCAPE.sub(r"\1", segment[start:end])
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
                state["size"] += len(segment)
        close()
        yield flush()

    streams = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    return streams.select("conv_id", "segment", "body_start", "body_end", "trained").mapInArrow(each, READ)
