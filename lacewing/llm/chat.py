"""Chat formatting by a declarative template and a finite-state machine over roles.

DataFrame functions only. The rows of a conversation are gathered by ``conv_id``: its
formatted text is one value, so a conversation has to fit in a row in any case.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    """How a role's turn is marked, and whether its text is under the loss."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role, a mark for all other roles, and the order in which roles may follow.

    ``transitions`` maps a state and a role to the next state (states are named freely);
    what it lacks leads to ``error``. A conversation is valid if it ends in ``accepts``.
    """

    turns: dict[str, Turn]
    transitions: dict[tuple[str, str], str]
    accepts: tuple[str, ...]
    other: Turn = field(default=Turn("[ROLE:", " [/ROLE]"))
    start: str = "start"

    def controls(self) -> list[str]:
        """The control strings, each an opening bracket and a tail without another one."""
        found = {m.strip() for t in (*self.turns.values(), self.other) for m in (t.opens, t.closes)}
        if bad := [c for c in found if not re.fullmatch(r"[<\[][^<\[\\]+", c)]:
            raise ValueError(f"control strings start with < or [ and have no other one: {bad}")
        return sorted(found)

    def pattern(self) -> str:
        return r"([<\[])(\\*)(" + "|".join(re.escape(c[1:]) for c in self.controls()) + ")"


#: Marks in the manner of common instruction formats.
TEMPLATE = ChatTemplate(
    turns={"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>", loss=True)},
    transitions={("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"},
    accepts=("assistant",),
)


def escaped(text: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """One more backslash after the bracket of each control string, backslashed or not.

    No control string is left, and ``unescaped`` gives the text back.
    """
    return F.regexp_replace(text, template.pattern(), r"$1\\$2$3")


def unescaped(text: Column, template: ChatTemplate = TEMPLATE) -> Column:
    return F.regexp_replace(text, template.pattern().replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _opens(role: Column, t: ChatTemplate) -> Column:
    out = F.concat(F.lit(t.other.opens), F.hex(F.encode(role, "UTF-8")), F.lit("] "))
    for name, turn in t.turns.items():
        out = F.when(role == name, F.lit(turn.opens)).otherwise(out)
    return out


def _of_role(role: Column, t: ChatTemplate, value: str) -> Column:
    out = F.lit(getattr(t.other, value))
    for name, turn in t.turns.items():
        out = F.when(role == name, F.lit(getattr(turn, value))).otherwise(out)
    return out


def format_chats(rows: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """``(conv_id, n_turns, valid, segments, formatted)`` for each conversation.

    ``rows`` has ``conv_id, turn, role, text``; other columns are ignored. Turns are
    ordered by ``turn`` (nulls first), ties by role and text; repeated rows count.
    A null role or text is empty; rows without a ``conv_id`` are one conversation with
    a null id. Roles that the template doesn't know are marked with their name in hex.
    ``segments`` is an array of (text, loss): marks, then escaped text, then marks;
    ``formatted`` joins them. Very long texts are formatted whole. Empty tables give no rows.
    """
    t = template
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    steps = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}>{role}", to)])
    state = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat(s, F.lit(">"), x["role"])), F.lit("error")))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    marked = lambda x: F.array(
        part(_opens(x["role"], t), F.lit(False)),
        part(escaped(x["text"], t), _of_role(x["role"], t, "loss")),
        part(_of_role(x["role"], t, "closes"), F.lit(False)),
    )
    out = chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"), state.isin(*t.accepts).alias("valid"), F.flatten(F.transform("turns", marked)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chat(formatted: Column, template: ChatTemplate = TEMPLATE) -> Column:
    """The turns that a formatted text was made of, as an array of (role, text)."""
    t, q = template, re.escape
    marks = [f"{q(x.opens)}.*?{q(x.closes)}" for x in t.turns.values()] + [rf"{q(t.other.opens)}[0-9A-F]*\] .*?{q(t.other.closes)}"]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(f"(?:{m})" for m in marks)), F.lit(0))

    def turn(s: Column) -> Column:
        named = F.substring_index(F.substring(s, len(t.other.opens) + 1, 1_000_000_000), "] ", 1)
        role, opens, closes = F.decode(F.unhex(named), "UTF-8"), F.length(named) + len(t.other.opens) + 2, F.lit(len(t.other.closes))
        for name, x in t.turns.items():
            here = s.startswith(x.opens)
            role = F.when(here, F.lit(name)).otherwise(role)
            opens = F.when(here, F.lit(len(x.opens))).otherwise(opens)
            closes = F.when(here, F.lit(len(x.closes))).otherwise(closes)
        return F.struct(role.alias("role"), unescaped(s.substr(opens + 1, F.length(s) - opens - closes), t).alias("text"))

    return F.transform(found, turn)


def chat_digests(chats: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Digests of the formatted output: of the turns read back, and of the text under the loss."""
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    read = F.transform(parse_chat(F.col("formatted"), template), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    out = chats.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), read.alias("read"), loss.alias("loss"))
    return out.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), digest(F.array_join("read", "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), digest(F.col("loss")).alias("loss_sha256"), "formatted_chars", "valid",
    )
