"""Chat formatting that is proved by a grammar round trip.

A conversation is the concatenation of its turns, and a turn is

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

The grammar is deterministic: ROLE ends at the first line feed, TEXT at the first control
string.  Reading undoes escapes: in a text ``<\\|im_end|>`` stands for ``<|im_end|>``, and
each further backslash for one more, and likewise for the start; in a role ``\\\\`` and ``\\n`` stand for a
backslash and a line feed.  A turn is rendered as it is and parsed again; while what comes back
differs from the source, the part that conflicts is escaped.  Most turns stay as they are, and a
text that merely looks escaped is a conflict like any other.

Rows are range-partitioned by (conversation, turn), so a conversation with very many turns is split
over tasks.  Each task streams its rows in order and holds one turn at a time.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lean, small_batches

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|im_(?:start|end)\|>")
_ESCAPED = re.compile(r"<\\(\\*\|im_(?:start|end)\|>)")
_CONFLICT = re.compile(r"<(\\*\|im_(?:start|end)\|>)")
_ROLE_ESCAPED = re.compile(r"\\([\\n])")


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def escape_text(text: str) -> str:
    return _CONFLICT.sub(r"<\\\1", text)


def read_text(body: str) -> str:
    return _ESCAPED.sub(r"<\1", body)


def escape_role(role: str) -> str:
    return escape_text(role.replace("\\", "\\\\").replace("\n", "\\n"))


def read_role(head: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else "\\", read_text(head))


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, from, to) of every turn; from and to bound the text's characters as they stand there."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise GrammarError(f"no turn starts at {at}")
        line = text.find("\n", at)
        head = text[at + len(START) : line]
        if line < 0 or _CONTROL.search(head):
            raise GrammarError(f"no role at {at}")
        stop = _CONTROL.search(text, line + 1)
        if stop is None or stop[0] != END or not text.startswith("\n", stop.end()):
            raise GrammarError(f"no end of the turn at {at}")
        turns.append((read_role(head), read_text(text[line + 1 : stop.start()]), line + 1, stop.start()))
        at = stop.end() + 1
    return turns


def settle(role: str, text: str) -> tuple[str, int, int, int]:
    """The turn's rendering that parses to exactly (role, text), bounds of its text, and how many parts were escaped."""
    head, body = role, text
    while True:
        out = f"{START}{head}\n{body}{END}\n"
        try:
            got = parse(out)
        except GrammarError:
            got = []
        if len(got) == 1 and got[0][:2] == (role, text):
            return out, got[0][2], got[0][3], (head != role) + (body != text)
        # the body alone, under a role without conflicts, shows which part it is
        try:
            fits = [x[1] for x in parse(f"{START}user\n{body}{END}\n")] == [text]
        except GrammarError:
            fits = False
        if not fits and body == text:
            body = escape_text(text)
        elif head == role:
            head = escape_role(role)
        else:
            raise GrammarError(f"no escape makes the turn of {role!r} read back as it was")


def format_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",), by_range: bool = True
) -> DataFrame:
    """conversation, part, place, turn, role, formatted, loss_from, loss_to, n_escaped of every row.

    A conversation's text is its ``formatted`` in the order of (part, place), which is how partitions
    hold the rows.  The loss mask covers the characters from ``loss_from`` up to ``loss_to`` of
    ``formatted``: the text of turns whose role is in ``trained``; it is null elsewhere.  Turns stand by number,
    null ones last, ties by role and text; a null text or role is empty, and null conversation ids are
    one conversation.  Repeated rows are separate turns; other columns are ignored; an empty table gives no
    rows.  A turn is held whole by one task, a conversation is not; with ``by_range`` off a conversation
    streams through one task.
    """
    small_batches(rows.sparkSession)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = rows.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), blank(role_col).alias("_role"), blank(text_col).alias("_text"))
    place = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_last(), F.col("_role")]
    # rows of one turn and role stand by text, and its prefix never contradicts that order
    dealt = x.repartitionByRange(*place, F.substring("_text", 1, 64)) if by_range else x.repartition("_conv")
    dealt = dealt.sortWithinPartitions(*place, "_text")
    kinds = [x.schema[c].dataType.simpleString() for c in ("_conv", "_turn")]

    def render(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            told, lo, hi, escaped = [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out, a, b, k = settle(role, text)
                told.append(out), escaped.append(k)
                lo.append(a if role in trained else None), hi.append(b if role in trained else None)
            n = len(told)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64()), batch.column(1), batch.column(2), pa.array(told, pa.string()), *(pa.array(v, pa.int32()) for v in (lo, hi, escaped))],
                names=["conversation", "part", "place", "turn", "role", "formatted", "loss_from", "loss_to", "n_escaped"],
            )
            place += n

    return dealt.mapInArrow(lean(render), f"conversation {kinds[0]}, part int, place long, turn {kinds[1]}, role string, formatted string, loss_from int, loss_to int, n_escaped int")


class _Digest:
    """What is read back from one conversation's text as it streams by."""

    def __init__(self, key):
        self.key, self.n, self.turns, self.loss, self.n_loss, self.chars = key, 0, hashlib.sha256(), hashlib.sha256(), 0, 0

    def add(self, formatted: str, lo: int | None, hi: int | None) -> None:
        for role, text, _, _ in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if lo is not None:
            masked = read_text(formatted[lo:hi])
            self.loss.update(masked.encode())
            self.n_loss += len(masked)
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.key, self.n, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from rows as ``format_turns`` gives them.

    Everything comes from parsing ``formatted`` again: the digest of role, line feed, text, line feed
    of every turn, and length and digest of all unescaped text under the mask.  One row for each
    conversation in each partition.  Partitions are streamed, with memory for one batch.
    """
    kind = formatted.schema["conversation"].dataType.simpleString()

    def stream(batches):
        now, rows, kinds = None, [], None

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_READ)

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for key, told, lo, hi in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if now is None or now.key != key:
                    rows += [now.row()] if now else []
                    now = _Digest(key)
                now.add(told, lo, hi)
            if len(rows) > 10_000:
                yield out()
                rows = []
        if now is not None:
            rows.append(now.row())
            yield out()

    plain = formatted.select("conversation", "formatted", "loss_from", "loss_to")
    return plain.mapInArrow(lean(stream), f"conversation {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def round_trip(rows: DataFrame, conv_col: str = "conv_id", **how) -> DataFrame:
    """One row of ``read_back`` for every conversation; takes what ``format_turns`` takes.

    A digest is sequential, so a conversation that lies across two range partitions (one for each
    border at most) is formatted once more and streamed through a task of its own: its work there is one
    sort and one pass, its memory one batch.  Null conversation ids are one conversation; an empty table gives no rows.
    """
    scratch = Scratch(rows.sparkSession, "chat")
    parts = scratch.write(read_back(format_turns(rows, conv_col, **how)), "parts")
    # bounded by the number of partitions
    across = scratch.write(parts.groupBy("conversation").count().filter("count > 1").select(F.col("conversation").alias("_across")), "across")
    here = lambda df, kind, c: df.join(F.broadcast(across), F.col(c).eqNullSafe(F.col("_across")), kind)
    if across.isEmpty():
        return parts
    again = read_back(format_turns(here(rows, "left_semi", conv_col), conv_col, by_range=False, **how))
    return here(parts, "left_anti", "conversation").union(again)
