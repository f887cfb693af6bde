"""Chat formatting: a finite-state machine over roles and a declarative template, all in DataFrame functions.

A template names, for each role, the header that opens its turns, whether its text counts for the loss, and the
roles that may precede it ("" is the start of a conversation). The machine's state is the last role; a turn whose
role may not follow the state moves it to a dead state. Formatting never depends on validity: every conversation is
formatted, and ``valid`` says what the machine decided.

Control strings (every header and the end of turn) inside a text are broken up by a backslash after their first
character, and backslashes are doubled, so that no control string is left in a text and the text can be restored
exactly. No control string may contain a backslash, or start with what one of them ends with; the template checks it.

Defined cases: null text or role counts as empty; an undeclared role gets a header with its UTF-8 bytes in
hexadecimal and makes the conversation invalid; turns are ordered by (turn, role, text) with nulls first, so ties and
repeated rows have one order; an empty table gives an empty result; further columns of the input are ignored.
A conversation is one row of the output, as a training example has to be.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, DEAD = "", "!"


@dataclass(frozen=True)
class Role:
    header: str
    loss: bool
    after: tuple[str, ...]


@dataclass(frozen=True)
class ChatTemplate:
    roles: Mapping[str, Role] = field(
        default_factory=lambda: {
            "system": Role("### System: ", False, (START,)),
            "user": Role("### User: ", False, (START, "system", "assistant")),
            "assistant": Role("### Assistant: ", True, ("user", "tool")),
            "tool": Role("### Tool: ", False, ("assistant", "tool")),
        }
    )
    end: str = "</turn>\n"
    other: str = "### @"
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        marks = self.controls()
        for a in marks:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"control string {a!r} is too short or has a backslash")
            for b in marks:
                if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                    raise ValueError(f"{b!r} may start inside {a!r}")

    def controls(self) -> list[str]:
        return [self.end.rstrip("\n"), self.other, *(r.header for r in self.roles.values())]


def escape(text: Column, template: ChatTemplate) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.controls():
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """(conv_id, formatted, segments array<struct<text, loss>>, valid, n_turns) of each conversation."""
    t = template or ChatTemplate()

    def header(role: Column) -> Column:
        out = F.concat(F.lit(t.other), F.hex(F.encode(role, "UTF-8")), F.lit(": "))
        for name, r in t.roles.items():
            out = F.when(role == name, r.header).otherwise(out)
        return out

    losing = [name for name, r in t.roles.items() if r.loss]
    moves = F.array(*[F.lit(f"{a}>{name}") for name, r in t.roles.items() for a in r.after])
    turns = F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    step = lambda state, x: F.when(F.array_contains(moves, F.concat(state, F.lit(">"), x["role"])), x["role"]).otherwise(F.lit(DEAD))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(header(x["role"]).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"], t).alias("text"), x["role"].isin(losing).alias("loss")),
                F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return (
        conversations.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select("conv_id", segments.alias("segments"), F.aggregate("turns", F.lit(START), step).isin(list(t.final)).alias("valid"), F.size("turns").cast("long").alias("n_turns"))
        .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "valid", "n_turns")
    )


def read_turns(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """array<struct<role, text>> of a formatted conversation, texts unescaped."""
    t = template or ChatTemplate()
    parts = F.split(formatted, rf"\Q{t.end}\E", -1)

    def turn(part: Column) -> Column:
        named = F.regexp_extract(part, rf"^\Q{t.other}\E([0-9A-F]*): ", 1)
        role, head = F.decode(F.unhex(named), "UTF-8"), F.length(F.lit(t.other)) + F.length(named) + 2
        for name, r in t.roles.items():
            fits = F.startswith(part, F.lit(r.header))
            role, head = F.when(fits, F.lit(name)).otherwise(role), F.when(fits, F.lit(len(r.header))).otherwise(head)
        return F.struct(role.alias("role"), unescape(F.substring(part, head + 1, F.length(part))).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """What ``op1_chat_format`` returns, read back from the formatted conversations."""
    return (
        formatted.withColumn("back", read_turns(F.col("formatted"), template))
        .withColumn("under", loss_text(F.col("segments")))
        .select(
            "conv_id",
            F.size("back").cast("long").alias("n_turns"),
            F.sha2(F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
            F.length("under").cast("long").alias("loss_chars"),
            F.sha2("under", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )
