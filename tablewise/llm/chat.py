"""Chat formatting with a finite-state machine over roles, in DataFrame functions only."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Turn:
    """How one role is written: marker before, marker after, and whether its text is learned."""

    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Declarative template.

    ``turns`` maps roles to markers; a role that is not listed is written with
    ``other``, whose role name stands between ``name_before`` and ``name_after``.
    ``moves`` lists the allowed (state, role) steps of the machine, whose states are
    the last role and ``start``; ``ends`` are the states a conversation may end in.
    """

    turns: dict[str, Turn] = field(
        default_factory=lambda: {
            "system": Turn("[SYS]", "[/SYS]"),
            "user": Turn("[INST]", "[/INST]"),
            "assistant": Turn("<s>", "</s>", True),
        }
    )
    name_before: str = "[ROLE]"
    name_after: str = "[/ROLE]"
    other_after: str = "[/TURN]"
    moves: tuple[tuple[str, str], ...] = (
        ("start", "system"),
        ("start", "user"),
        ("system", "user"),
        ("user", "assistant"),
        ("assistant", "user"),
    )
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> list[str]:
        marks = [m for t in self.turns.values() for m in (t.before, t.after)]
        return sorted({*marks, self.name_before, self.name_after, self.other_after})

    def __post_init__(self) -> None:
        for mark in self.controls:
            if not re.fullmatch(r"[<\[]/?\w+[>\]]", mark):
                raise ValueError(f"a marker looks like <name> or [name]: {mark}")


def _quoted(template: Template) -> tuple[str, str]:
    firsts = "".join(sorted({re.escape(m[0]) for m in template.controls}))
    tails = "|".join(sorted(re.escape(m[1:]) for m in template.controls))
    return f"([{firsts}])", f"({tails})"


def escape(text: Column, template: Template) -> Column:
    """Put a backslash behind the first character of every control string in ``text``.

    A control string that already has backslashes there gets one more, which makes
    the step reversible for any text.
    """
    first, tail = _quoted(template)
    return F.regexp_replace(text, rf"{first}(\\*){tail}", r"$1\\$2$3")


def unescape(text: Column, template: Template) -> Column:
    first, tail = _quoted(template)
    return F.regexp_replace(text, rf"{first}\\(\\*){tail}", r"$1$2$3")


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per ``conv_id``: segments with loss flags, the whole text, and the loss spans.

    Input: conv_id, turn, role, text (other columns are ignored). Turns are ordered by
    turn, then role, then text, nulls first; repeated rows are repeated turns. A null
    text or role counts as empty, rows of a null conv_id form one conversation, and an
    empty table gives no row. ``valid`` tells whether the machine accepts the order of
    roles; conversations it rejects are formatted all the same.

    Output: conv_id, roles, segments (array of text, loss), formatted, loss_spans
    (array of start from 0 and length, in code points), valid. A conversation is one
    value here, so it is gathered in one task, as its text must be.
    """
    template = template or Template()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    before = F.concat(F.lit(template.name_before), escape(role, template), F.lit(template.name_after))
    after, loss = F.lit(template.other_after), F.lit(False)
    for name, turn in template.turns.items():
        before = F.when(role == name, F.lit(turn.before)).otherwise(before)
        after = F.when(role == name, F.lit(turn.after)).otherwise(after)
        loss = F.when(role == name, F.lit(turn.loss)).otherwise(loss)
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            role.alias("role"),
            text.alias("raw"),
            before.alias("before"),
            escape(text, template).alias("text"),
            after.alias("after"),
            loss.alias("loss"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def segment(value: Column, flag: Column) -> Column:
        return F.struct(value.alias("text"), flag.alias("loss"))

    parts = grouped.select(
        "conv_id",
        F.transform("t", lambda t: t["role"]).alias("roles"),
        F.flatten(
            F.transform(
                "t",
                lambda t: F.array(
                    segment(t["before"], F.lit(False)),
                    segment(t["text"], t["loss"]),
                    segment(t["after"], F.lit(False)),
                ),
            )
        ).alias("segments"),
    )
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["text"])).alias("at"),
            F.when(
                x["loss"],
                F.concat(s["spans"], F.array(F.struct(s["at"].alias("start"), F.length(x["text"]).cast("long").alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    moves = [F.concat_ws("\n", F.lit(a), F.lit(b)) for a, b in template.moves]

    def step(state: Column, name: Column) -> Column:
        return F.when(F.concat_ws("\n", state, name).isin(*moves), name).otherwise(F.lit("\n"))

    state = F.aggregate("roles", F.lit("start"), step)
    return parts.select(
        "conv_id",
        "roles",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        state.isin(*template.ends).alias("valid"),
    )


def parse_chats(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text), read back from the formatted text alone."""
    template = template or Template()
    named = rf"{re.escape(template.name_before)}.*?{re.escape(template.name_after)}"
    forms = [rf"{re.escape(t.before)}.*?{re.escape(t.after)}" for t in template.turns.values()]
    forms.append(rf"{named}.*?{re.escape(template.other_after)}")
    found = F.regexp_extract_all(formatted, F.lit("(?s)(" + "|".join(forms) + ")"), F.lit(1))

    def read(x: Column) -> Column:
        cut = F.instr(x, template.name_after)
        name = F.substring(x, F.lit(len(template.name_before) + 1), cut - F.lit(len(template.name_before) + 1))
        rest = F.substring(
            x,
            cut + F.lit(len(template.name_after)),
            F.length(x) - cut - F.lit(len(template.name_after) - 1 + len(template.other_after)),
        )
        for role, turn in template.turns.items():
            here = F.startswith(x, F.lit(turn.before))
            name = F.when(here, F.lit(role)).otherwise(name)
            size = F.length(x) - F.lit(len(turn.before) + len(turn.after))
            rest = F.when(here, F.substring(x, F.lit(len(turn.before) + 1), size)).otherwise(rest)
        return F.struct(unescape(name, template).alias("role"), unescape(rest, template).alias("text"))

    return F.transform(found, read)
