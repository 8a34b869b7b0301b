"""Conversations as training text: turn order checked by a finite-state
machine, text emitted in segments with a loss flag each.

A template is data (`Template`): per role the text before and after a turn
and whether the turn's own text carries loss. Control strings inside a turn's
text get a backslash after their first character; one that already carries
backslashes there gets one more, so taking one away restores every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shared import only

START = "start"
VALID_END = frozenset({"user", "assistant"})


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Roles, their marks, and the order in which roles may follow each other."""

    opening: str = "<s>"
    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("<<SYS>>", "<</SYS>>"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<ANS>", "</s>", loss=True),
        }
    )
    other_open: str = "[ROLE="
    other_mid: str = "|]"
    other_close: str = "[/ROLE]"
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            START: ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )

    def controls(self) -> list[str]:
        """Every string that has a meaning in the output, longest first."""
        marks = {self.opening, self.other_open, self.other_mid, self.other_close}
        for turn in self.turns.values():
            marks |= {turn.before, turn.after}
        return sorted(marks, key=lambda mark: (-len(mark), mark))

    def guard(self) -> str:
        """Regular expression of a control string with any number of
        backslashes after its first character: groups head, slashes, tail."""
        by_head: dict[str, list[str]] = {}
        for mark in self.controls():
            by_head.setdefault(mark[0], []).append(re.escape(mark[1:]))
        return "|".join(
            rf"({re.escape(head)})(\\*)({'|'.join(tails)})" for head, tails in sorted(by_head.items())
        )


LLAMA = Template()


class Codec:
    """Writes turns by a template and reads them back."""

    def __init__(self, template: Template = LLAMA):
        self.template = template
        self._guard = re.compile(template.guard())
        self._marks = re.compile("|".join(map(re.escape, template.controls())))

    def escape(self, text: str) -> str:
        return self._guard.sub(lambda m: _respell(m, 1), text)

    def unescape(self, text: str) -> str:
        return self._guard.sub(lambda m: _respell(m, -1), text)

    def segments(self, role: str, text: str, first: bool) -> list[tuple[str, bool]]:
        """One turn as (text, carries loss) segments."""
        turn = self.template.turns.get(role)
        if turn is None:
            before = self.template.other_open + self.escape(role) + self.template.other_mid
            turn = Turn(before, self.template.other_close)
        opening = self.template.opening if first else ""
        return [(opening + turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of an output, by its marks alone."""
        openers = {turn.before: role for role, turn in self.template.turns.items()}
        closers = {turn.after for turn in self.template.turns.values()} | {self.template.other_close}
        found, role, begin, named = [], None, 0, None
        for mark in self._marks.finditer(formatted):
            what = mark.group()
            if role is None and named is None:
                if what in openers:
                    role, begin = openers[what], mark.end()
                elif what == self.template.other_open:
                    named = mark.end()
            elif named is not None and what == self.template.other_mid:
                role, begin, named = self.unescape(formatted[named : mark.start()]), mark.end(), None
            elif what in closers:
                found.append((role, self.unescape(formatted[begin : mark.start()])))
                role = None
        return found


def _respell(match: re.Match, by: int) -> str:
    head, slashes, tail = next(
        match.groups()[at : at + 3] for at in range(0, len(match.groups()), 3) if match.groups()[at]
    )
    return head + "\\" * max(0, len(slashes) + by) + tail


def turn_order(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Conversations side by side, each in turn order within one partition.

    Ties of `turn` go by role and text, NULL turns come first, repeated rows
    stay. NULL roles and texts count as empty, a NULL id is an id of its own.
    """
    rows = only(conversations, conv_id=conv_id, turn=turn, role=role, text=text).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(ordered: DataFrame, template: Template = LLAMA) -> DataFrame:
    """One row per turn: its place, formatted text, the segments with their
    loss flags, and whether the turn may follow the one before it.

    Takes the output of `turn_order` and walks each partition once, keeping
    one role in memory, so a conversation of any length takes no more room.
    A turn out of order is formatted too, with `in_order` false.
    """
    schema = (
        "conv_id long, position long, role string, formatted string, in_order boolean, "
        "segments array<struct<text:string,loss:boolean>>"
    )

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(template)
        now: object = object()
        state, position = START, 0
        for frame in frames:
            out = []
            for conv, role, text in zip(_ids(frame.conv_id), frame.role, frame.text, strict=True):
                if conv != now:
                    now, state, position = conv, START, 0
                parts = codec.segments(role, text, position == 0)
                out.append(
                    (
                        conv,
                        position,
                        role,
                        "".join(part for part, _ in parts),
                        role in template.follows.get(state, ()),
                        [{"text": part, "loss": loss} for part, loss in parts],
                    )
                )
                state, position = role, position + 1
            yield pd.DataFrame(
                out, columns=["conv_id", "position", "role", "formatted", "in_order", "segments"]
            ).astype({"conv_id": "Int64"})

    return ordered.mapInPandas(walk, schema)


def read_back(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """Digests of conversations as their formatted text tells them.

    Takes the rows of `format_turns` as they come: partitions still hold
    whole conversations in order. Roles and texts are parsed from
    `formatted`; the loss mask is taken from the segments.
    """
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, valid boolean"
    )

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(template)
        now: object = object()
        state: _Digest | None = None
        for frame in frames:
            out = []
            for conv, chunk, in_order, segments in zip(
                _ids(frame.conv_id), frame.formatted, frame.in_order, frame.segments, strict=True
            ):
                if state is None or conv != now:
                    if state is not None:
                        out.append(state.row(now))
                    now, state = conv, _Digest()
                state.add(codec, chunk, bool(in_order), segments)
            yield _digests(out)
        if state is not None:
            yield _digests([state.row(now)])

    return formatted.select("conv_id", "formatted", "in_order", "segments").mapInPandas(digest, schema)


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.valid = True

    def add(self, codec: Codec, chunk: str, in_order: bool, segments) -> None:
        for role, text in codec.read(chunk):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for segment in segments:
            if segment["loss"]:
                text = codec.unescape(segment["text"])
                self.loss.update(text.encode())
                self.loss_chars += len(text)
        self.formatted_chars += len(chunk)
        self.valid = self.valid and in_order

    def row(self, conv) -> tuple:
        return (
            conv,
            self.n_turns,
            self.turns.hexdigest(),
            self.loss_chars,
            self.loss.hexdigest(),
            self.formatted_chars,
            self.valid,
        )


def _digests(rows: list[tuple]) -> pd.DataFrame:
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})


def _ids(column: pd.Series) -> list:
    """Ids as integers, None for NULL (pandas turns a column with NULLs into floats)."""
    return [None if value is None else int(value) for value in column.astype(object).where(column.notna(), None)]


def format_conversations(
    conversations: DataFrame,
    template: Template = LLAMA,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """`format_turns` of `turn_order`: the formatted rows of all conversations.

    An empty table gives no rows; other columns are ignored whatever their
    names. Ids must be integers.
    """
    return format_turns(turn_order(conversations, conv_id, turn, role, text), template)
