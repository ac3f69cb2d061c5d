"""Chat formatting: a declarative template, turn order by a finite-state machine, loss flags per segment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that open or close markers, the escape character itself, and their escapes.
#: An escaped text holds none of the first three raw, so a marker can't occur in it.
ESCAPES = (("\\", "\\b"), ("[", "\\o"), ("<", "\\l"), ("]", "\\c"))


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Markers start with ``[`` or ``<``; ``other`` is used for roles not in ``turns`` and names them."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS]", "[/SYS]"), "user": Turn("[INST]", "[/INST]"), "assistant": Turn("[OUT]", "</s>", True)})
    other: Turn = Turn("[ROLE=", "[/ROLE]")
    begin: str = "<s>"
    # state -> role -> next state; any other role leads to "invalid"
    steps: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "system", "user": "user"}, "system": {"user": "user"},
        "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    ends: tuple[str, ...] = ("assistant",)


def escape(text: Column) -> Column:
    for raw, coded in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def _by_role(template: Template, role: Column, value) -> Column | None:
    found = None
    for name, turn in template.turns.items():
        found = F.when(role == name, F.lit(value(turn))) if found is None else found.when(role == name, F.lit(value(turn)))
    return found


def _segments(template: Template, t: Column) -> Column:
    own = F.concat(F.lit(template.other.before), escape(t["role"]), F.lit("]"))
    parts = ((_by_role(template, t["role"], lambda x: x.before).otherwise(own), F.lit(False)),
             (escape(t["text"]), _by_role(template, t["role"], lambda x: x.loss).otherwise(F.lit(template.other.loss))),
             (_by_role(template, t["role"], lambda x: x.after).otherwise(F.lit(template.other.after)), F.lit(False)))
    return F.array(*[F.struct(text.alias("text"), loss.alias("loss")) for text, loss in parts])


def format_chats(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, segments array<struct<text, loss>>, formatted, state, valid``.

    Turns are ordered by ``turn``, a missing one first, ties by role and text; repeated rows are turns of
    their own.  Missing roles and texts are empty.  ``state`` is where the state machine ends; conversations
    in a wrong order are formatted too, with ``valid`` false.  A missing ``conv_id`` is a conversation of its own.
    A formatted conversation is one string, so its turns meet in one row, gathered in parts before the shuffle.
    """
    template = template or Template()
    blank = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    moves = F.create_map(*[F.lit(x) for s, to in template.steps.items() for r, n in to.items() for x in (f"{s}>{r}", n)])
    state = F.aggregate("_turns", F.lit("start"), lambda s, t: F.coalesce(
        F.try_element_at(moves, F.concat(s, F.lit(">"), t["role"])), F.lit("invalid")))
    parts = F.flatten(F.transform("_turns", lambda t: _segments(template, t)))
    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    return (chats.withColumn("segments", F.concat(begin, parts)).withColumn("state", state)
            .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
            .select("conv_id", "segments", "formatted", "state", F.col("state").isin(*template.ends).alias("valid")))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation, ``array<struct<role, text>>``, from its text alone."""
    template = template or Template()
    marker = r"\[(?!/)([^\]]*\])([^\[<]*)"
    heads, texts = F.regexp_extract_all(formatted, F.lit(marker), F.lit(1)), F.regexp_extract_all(formatted, F.lit(marker), F.lit(2))
    named = F.create_map(*[F.lit(x) for name, turn in template.turns.items() for x in (turn.before[1:], name)])
    prefix = template.other.before[1:]
    other = lambda h: unescape(F.substring(h, F.lit(len(prefix) + 1), F.length(h) - (len(prefix) + 1)))
    return F.zip_with(heads, texts, lambda h, t: F.struct(
        F.coalesce(F.try_element_at(named, h), other(h)).alias("role"), unescape(t).alias("text")))
