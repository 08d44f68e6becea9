"""Chat formatting with DataFrame functions only.

A declarative template says what stands before and after each role's turn and whose text is trained
on. A finite-state machine over the roles of a conversation checks the order of turns. The output is
a list of text segments, each with a loss flag; their concatenation is the formatted text. Control strings inside texts and
roles are escaped, and read_back() undoes that exactly.

Null texts count as empty, null roles as an empty role. Turns are put in order by (turn, role, text), so ties
and repeated rows have a defined place; every row is a turn. An empty table gives no rows. Roles that the template doesn't name
are formatted with its default turn and make the conversation invalid. A conversation is one row of
the result, so all its turns meet in one task; conversations are spread by their id.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Control strings, the roles under the loss mask and the allowed moves of the state machine."""

    opens: str = "<|turn|>"
    after_role: str = "<|says|>"
    closes: str = "<|end|>"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: from state to state; a state is the last role, "start" before any.
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",), "tool": ("assistant",)})
    #: states in which a conversation may end.
    ends: tuple[str, ...] = ("assistant", "user")

    @property
    def controls(self) -> tuple[str, ...]:
        return self.opens, self.after_role, self.closes


def escaped(text: Column, t: Template) -> Column:
    """No control string is left: the escape character is doubled, and put after the first character of each control string."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for c in t.controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + t.escape + c[1:]))
    return out


def unescaped(text: Column, t: Template) -> Column:
    quoted = "".join(f"\\x{{{ord(x):x}}}" for x in t.escape)
    return F.regexp_replace(text, f"(?s){quoted}(.)", "$1")


def formatted(turns: DataFrame, template: Template | None = None, keys: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """conv_id, segments (array of text and loss), text, valid, first_error (the place of the first turn out of order, from 0, or null)."""
    t = template or Template()
    conv, turn, role, text = keys
    rows = turns.select(
        turns[conv].alias("conv_id"), F.struct(turns[turn].cast("long").alias("turn"), F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"), F.coalesce(turns[text].cast("string"), F.lit("")).alias("text")).alias("said")
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    allowed = F.create_map(*[F.lit(x) for a, to in t.moves.items() for b in to for x in (f"{a}>{b}", b)])

    def step(state: Column, said: Column) -> Column:
        to = F.try_element_at(allowed, F.concat(state["at"], F.lit(">"), said["role"]))
        bad = state["error"].isNotNull() | to.isNull()
        return F.struct(F.when(bad, state["at"]).otherwise(to).alias("at"), F.when(bad, F.coalesce(state["error"], state["n"])).alias("error"), (state["n"] + 1).alias("n"))

    start = F.struct(F.lit("start").alias("at"), F.lit(None).cast("int").alias("error"), F.lit(0).alias("n"))

    def segment(piece: Column, loss: Column) -> Column:
        return F.struct(piece.alias("text"), loss.alias("loss"))

    def parts(said: Column) -> Column:
        loss = said["role"].isin(*t.loss_roles)
        head = F.concat(F.lit(t.opens), escaped(said["role"], t), F.lit(t.after_role))
        return F.array(segment(head, F.lit(False)), segment(escaped(said["text"], t), loss), segment(F.lit(t.closes), F.lit(False)))

    out = whole.select("conv_id", F.aggregate("said", start, step).alias("fsm"), F.flatten(F.transform("said", parts)).alias("segments"))
    return out.select(
        "conv_id",
        "segments",
        F.array_join(F.col("segments.text"), "").alias("text"),
        (F.col("fsm.error").isNull() & F.col("fsm.at").isin(*t.ends)).alias("valid"),
        F.col("fsm.error").alias("first_error"),
    )


def read_back(text: Column, template: Template | None = None) -> Column:
    """The turns (array of role and text) of a formatted text."""
    t = template or Template()

    def literal(c: str) -> str:
        return "".join(f"\\x{{{ord(x):x}}}" for x in c)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, literal(t.after_role), 2)
        role = F.substring(halves[0], len(t.opens) + 1, 1 << 30)
        return F.struct(unescaped(role, t).alias("role"), unescaped(halves[1], t).alias("text"))

    pieces = F.split(text, literal(t.closes))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(segments: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped."""
    t = template or Template()
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"], t)), "")
