"""Chat formatting with built-in functions only: turn order, template, escaping, loss mask, reading back.

A conversation's turns are gathered in order. A finite-state machine over the
roles says whether they take turns as they should. A declarative template then
gives text segments, each with a flag whether its characters count in the loss;
the formatted conversation is their concatenation. Texts and roles are escaped
so that no control string can appear inside them, which makes the format
readable back without loss.

Defined results: null texts and roles are empty; null turns come first; rows of
the same turn follow by role and text; repeated rows are turns of their own;
rows without a conv_id form one conversation; an empty table gives none.
Conversations out of order are formatted too, and marked as not valid.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around roles and texts, which roles are learned, and which may follow each other.

    ``before`` and ``after`` must contain a character of ``guarded``, as escaped texts have none of these.
    """

    before: str = "### "
    between: str = ": "
    after: str = "</turn>\n"
    guarded: Mapping[str, str] = field(default_factory=lambda: {"\\": "b", "#": "h", "<": "l", ":": "c"})
    learned: Sequence[str] = ("assistant",)
    follows: Mapping[str, Sequence[str]] = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    final: Sequence[str] = ("assistant", "user")


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """Guarded characters become a backslash and a letter; the backslash itself goes first."""
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit("\\" + x[1])), template.guarded.items(), text)


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    """Undoes ``escape``; the backslash goes last. Every backslash there is leads such a pair."""
    pairs = reversed(list(template.guarded.items()))
    return reduce(lambda c, x: F.replace(c, F.lit("\\" + x[1]), F.lit(x[0])), pairs, text)


def turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order, as structs ``(turn, role, text)``."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    return rows.groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))


def final_state(roles: Column, template: Template = TEMPLATE) -> Column:
    """The role at which the machine ends, or null from the first role on that may not follow its predecessor."""
    steps = [(a, b) for a, allowed in template.follows.items() for b in allowed]

    def step(state: Column, role: Column) -> Column:
        moves = F.create_map(*(F.lit(x) for a, b in steps for x in (f"{a}\n{b}", b)))
        return F.element_at(moves, F.concat(state, F.lit("\n"), role))

    return F.aggregate(roles, F.lit("start"), step)


def format_conversations(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """``(conv_id, valid, segments, formatted)`` for rows of ``turns``; segments are structs ``(text, loss)``."""
    valid = F.coalesce(final_state(F.col("turns.role"), template).isin(*template.final), F.lit(False))

    def parts(turn: Column) -> Column:
        head = F.concat(F.lit(template.before), escape(turn["role"], template), F.lit(template.between))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(turn["text"], template), turn["role"].isin(*template.learned)),
            segment(F.lit(template.after), F.lit(False)),
        )

    cut = conversations.select("conv_id", valid.alias("valid"), F.flatten(F.transform("turns", parts)).alias("segments"))
    return cut.withColumn("formatted", F.array_join("segments.text", ""))


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted conversation as structs ``(role, text)``."""
    quoted = lambda marker: "\\Q" + marker + "\\E"
    pieces = F.split(formatted, quoted(template.after))
    # the last piece is what follows the last turn: nothing
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(template.before) + 1)), quoted(template.between), 2)
        return F.struct(unescape(halves[0], template).alias("role"), unescape(halves[1], template).alias("text"))

    return F.transform(pieces, turn)


def learned_text(segments: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    marked = F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return F.array_join(marked, "")
