"""Chat formatting by a finite-state machine over roles and a declarative template."""

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
    """Marks around each role's text, and the roles whose text is learned.

    A text stands between blanks and no control string has one, so a text can't
    complete a control string of its surroundings.
    """

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<<ANS>>", "</s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    learned: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a role without an entry is out of turn
    turns: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    final: tuple[str, ...] = ("user", "assistant")

    @property
    def controls(self) -> list[str]:
        return [self.begin, *(m for pair in self.marks.values() for m in pair), *self.other]


def escaper(t: Template):
    """Doubles backslashes and puts one behind the first character of each control string."""
    any_control = re.compile("(?=" + "|".join(map(re.escape, t.controls)) + ")(.)", re.S)
    return lambda text: any_control.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def segments(turns: list[tuple[str, str]], t: Template) -> list[tuple[str, bool]]:
    """Text segments of a conversation, each with its loss flag."""
    escape = escaper(t)
    out = [(t.begin, False)]
    for role, text in turns:
        if role in t.marks:
            out += [(f"{t.marks[role][0]} ", False), (escape(text), role in t.learned), (f" {t.marks[role][1]}", False)]
        else:
            out += [(f"{t.other[0]} {escape(role)} {t.other[1]} ", False), (escape(text), role in t.learned), (f" {t.other[2]}", False)]
    return out


def check(roles: list[str], t: Template) -> str | None:
    """What the machine objects to first, None for a valid order."""
    state = "start"
    for k, role in enumerate(roles):
        if role not in t.turns.get(state, {}):
            return f"turn {k}: {role or 'no role'} after {state}"
        state = t.turns[state][role]
    return None if state in t.final else f"ends after {state}"


def reader(t: Template):
    """Reads formatted text back into (role, text) turns."""
    parts = [f"{re.escape(a)} (?P<r{i}>.*?) {re.escape(b)}" for i, (a, b) in enumerate(t.marks.values())]
    parts.append(f"{re.escape(t.other[0])} (?P<role>.*?) {re.escape(t.other[1])} (?P<text>.*?) {re.escape(t.other[2])}")
    turn, roles = re.compile("|".join(parts), re.S), list(t.marks)

    def read(formatted: str) -> list[tuple[str, str]]:
        assert formatted.startswith(t.begin)
        out, at = [], len(t.begin)
        while at < len(formatted):
            m = turn.match(formatted, at)
            if m is None:
                raise ValueError(f"no turn at {at}")
            named = {k: v for k, v in m.groupdict().items() if v is not None}
            out.append((unescape(named["role"]), unescape(named["text"])) if "role" in named else next((roles[int(k[1:])], unescape(v)) for k, v in named.items()))
            at = m.end()
        return out

    return read


def format_chats(rows: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, valid, error, formatted, segments (text, loss).

    Turns are ordered by turn, then role, then text (nulls first), so ties and
    repeated rows have a defined order and all stay.  A null text or role is empty;
    rows with a null conversation id form one conversation.  A conversation out of
    turn is formatted all the same and marked invalid.
    """
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, chats = b.column(0), b.column(1).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for chat in chats:
                turns = [(x["role"] or "", x["text"] or "") for x in chat]
                parts = segments(turns, t)
                wrong = check([r for r, _ in turns], t)
                for out, x in zip(rows, (len(turns), wrong is None, wrong, "".join(p for p, _ in parts), [{"text": p, "loss": f} for p, f in parts]), strict=True):
                    out.append(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.bool_()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string()), pa.array(rows[4], pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))],
                names=["id", "n_turns", "valid", "error", "formatted", "segments"],
            )

    kind = rows.schema[conv_col].dataType.simpleString()
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    chats = rows.groupBy(F.col(conv_col).alias("id")).agg(F.sort_array(F.collect_list(turn)).alias("chat"))
    schema = f"id {kind}, n_turns long, valid boolean, error string, formatted string, segments array<struct<text:string,loss:boolean>>"
    return chats.mapInArrow(run, schema).withColumnRenamed("id", conv_col)


def digests(chats: DataFrame, template: Template | None = None, conv_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, read back from their text and segments."""
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(t)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for formatted, parts in zip(b.column("formatted").to_pylist(), b.column("segments").to_pylist(), strict=True):
                turns = read(formatted)
                assert "".join(p["text"] for p in parts) == formatted
                learned = "".join(unescape(p["text"]) for p in parts if p["loss"])
                for out, x in zip(
                    rows,
                    (
                        len(turns),
                        hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                        len(learned),
                        hashlib.sha256(learned.encode()).hexdigest(),
                        len(formatted),
                    ),
                    strict=True,
                ):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(r, pa.string() if k in (1, 3) else pa.int64()) for k, r in enumerate(rows))], names=["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema[conv_col].dataType.simpleString()
    schema = f"id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select(F.col(conv_col).alias("id"), "formatted", "segments").mapInArrow(run, schema).withColumnRenamed("id", conv_col)
