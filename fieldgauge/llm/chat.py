r"""Chat formatting as a finite-state machine over roles, in DataFrame expressions only.

A ``Template`` names, for each role, the opening and closing text, whether its body is trained on,
and which roles may come before it. The state of the machine is the role of the previous turn, so
one window with ``lag`` checks every turn and rows stay one per turn.

Inside a body every character that the marks are made of is written as a two-character code
(``\`` as ``\b``, ``#`` as ``\h``, ``<`` as ``\l``; in a role also ``:`` as ``\c``). A mark can then
never appear in a body, and ``unescape`` is exact.

Defined cases: null text and null role are empty strings; turns are ordered by turn number (null
first), then role, then text, so repeated rows stay in the output; a role the template does not know
is formatted without loss and makes its turn invalid; an empty table gives no rows; other columns are
dropped. A null conversation number is a conversation of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_CODES = (*CODES, (":", "\\c"))
CLOSE = "</turn>\n"


@dataclass(frozen=True)
class Turn:
    """What a role looks like; ``after`` holds the roles that may stand before it, None for the start."""

    role: str
    loss: bool
    after: tuple[str | None, ...]


@dataclass(frozen=True)
class Template:
    turns: tuple[Turn, ...]
    last: tuple[str, ...]


CHAT = Template(
    (
        Turn("system", False, (None,)),
        Turn("user", False, (None, "system", "assistant")),
        Turn("assistant", True, ("user",)),
    ),
    ("assistant",),
)


def escape(text: Column, codes=CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes=CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(rows: DataFrame, template: Template = CHAT) -> DataFrame:
    """``conv_id, place, role, valid, ends, segments`` for every turn.

    ``segments`` are the texts of the turn in order, each with its loss flag. ``valid`` says that the
    machine may go from the turn before to this one, ``ends`` that this is the last turn and that it
    may be the last.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), role, text)
    turns = rows.select(
        "conv_id", role.alias("role"), text.alias("text"),
        F.row_number().over(order).cast("bigint").alias("place"),
        F.lag(role).over(order).alias("_before"),
        F.lead(F.lit(1)).over(order).isNull().alias("_last"),
    )
    legal, loss = F.lit(False), F.lit(False)
    for t in template.turns:
        here = F.col("role") == t.role
        before = [F.col("_before").isNull() if b is None else F.coalesce(F.col("_before") == b, F.lit(False)) for b in t.after]
        step = before[0]
        for b in before[1:]:
            step = step | b
        legal = legal | (here & step)
        loss = loss | (here & F.lit(t.loss))
    part = lambda c, flag: F.struct(c.alias("text"), flag.alias("loss"))
    return turns.select(
        "conv_id", "place", "role", legal.alias("valid"),
        F.when(F.col("_last"), F.col("role").isin(*template.last)).alias("ends"),
        F.array(
            part(F.concat(F.lit("### "), escape(F.col("role"), ROLE_CODES), F.lit(": ")), F.lit(False)),
            part(escape(F.col("text")), loss),
            part(F.lit(CLOSE), F.lit(False)),
        ).alias("segments"),
    )


def join_turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted``, ``trained`` (text under the loss mask), ``n_turns``, ``valid``.

    A formatted conversation is one value, so a conversation must fit a task here; ``format_turns``
    has no such bound.
    """
    whole = F.array_join(F.transform("segments", lambda s: s["text"]), "")
    under = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")
    per_turn = turns.select("conv_id", "valid", "ends", F.struct("place", whole.alias("w"), under.alias("u")).alias("_t"))
    grouped = per_turn.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("_t")).alias("_t"),
        F.count(F.lit(1)).alias("n_turns"),
        (F.min("valid") & F.coalesce(F.min("ends"), F.lit(False))).alias("valid"),
    )
    return grouped.select(
        "conv_id", "n_turns", "valid",
        F.array_join(F.transform("_t", lambda t: t["w"]), "").alias("formatted"),
        F.array_join(F.transform("_t", lambda t: t["u"]), "").alias("trained"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    turns = F.filter(F.split(formatted, CLOSE), lambda t: t != "")

    def turn(t: Column) -> Column:
        colon = F.instr(t, ": ")
        return F.struct(
            unescape(F.substring(t, F.lit(5), colon - 5), ROLE_CODES).alias("role"),
            unescape(F.substring(t, colon + 2, F.length(t))).alias("text"),
        )

    return F.transform(turns, turn)
