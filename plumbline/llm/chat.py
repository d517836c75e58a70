"""Preference formatting of chosen and rejected conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh

#: How a turn is rendered: its role between the first two marks, then its text, then the last.
OPEN, AFTER_ROLE, CLOSE = "<|", "|>\n", "\n<|end|>\n"


def conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, turns array<struct<role, text>>): the turns of each conversation in order.

    Turns with equal numbers come in order of role and text; rows that repeat a turn in full count once; a null role or
    text counts as empty; rows with a null id or number are no turns.  A conversation is one row, so its turns meet in one
    task; conversations are many and bounded by what one model context can hold.
    """
    clean = turns.where(F.col(id_col).isNotNull() & F.col(turn_col).isNotNull())
    turn = F.struct(F.col(turn_col).cast("long").alias("n"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = F.array_sort(F.array_distinct(F.collect_list(turn)))
    return clean.groupBy(id_col).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column, role: str) -> Column:
    """Half-open code-point ranges, in the rendered turns, of what is trained on: text and closing mark of turns of `role`."""
    lead, whole = len(OPEN) + len(AFTER_ROLE), len(OPEN) + len(AFTER_ROLE) + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(state: Column, t: Column) -> Column:
        at, n = state["at"], F.char_length(t["role"]) + F.char_length(t["text"])
        span = F.struct((at + lead + F.char_length(t["role"])).alias("start"), (at + n + whole).alias("end"))
        return F.struct((at + n + whole).alias("at"), F.when(t["role"] == role, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    return F.aggregate(turns, start, step, lambda s: s["found"])


def preference(pairs: DataFrame, turns: DataFrame, *, chosen_col: str = "chosen_id", rejected_col: str = "rejected_id", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", role: str = "assistant") -> DataFrame:
    """pairs with n_common, prompt, chosen, rejected, chosen_spans, rejected_spans; a name that pairs has gets an underscore.

    n_common is the length of the longest common prefix of both conversations' turns (equal role and text).  It is
    rendered once, as the prompt; what follows on either side is a completion.  The spans mask a completion: the ranges,
    in code points from its start, that count for the loss, which are the texts and closing marks of `role`'s turns.

    A conversation without rows is empty; a pair with equal conversations has empty completions; a pair whose first
    turns differ has an empty prompt; a null id means an empty side; repeated pairs stay.  Pairs meet their turns in two
    joins by conversation, so a prompt shared by many pairs gathers nowhere.
    """
    whole = conversations(turns, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    side = lambda name, key: whole.select(F.col(id_col).alias(key), F.col("turns").alias(name))
    c, ci, r, ri = fresh(pairs, "__c", "__ci", "__r", "__ri")
    both = pairs.join(side(c, ci), F.col(chosen_col) == F.col(ci), "left").drop(ci).join(side(r, ri), F.col(rejected_col) == F.col(ri), "left").drop(ri)
    return _formatted(both, pairs, c, r, role)


def _formatted(both: DataFrame, pairs: DataFrame, c: str, r: str, role: str) -> DataFrame:
    none = F.array().cast("array<struct<role:string,text:string>>")
    both = both.withColumn(c, F.coalesce(c, none)).withColumn(r, F.coalesce(r, none))
    n, p, one, two = fresh(both, "__n", "__p", "__one", "__two")
    shortest = F.least(F.size(c), F.size(r))
    differs = F.filter(F.sequence(F.lit(0), shortest), lambda i: (i == shortest) | ~F.get(c, i).eqNullSafe(F.get(r, i)))
    both = both.withColumn(n, F.array_min(differs))
    rest = lambda name: F.slice(name, F.col(n) + 1, F.greatest(F.size(name) - F.col(n), F.lit(0)))
    both = both.withColumn(p, F.slice(c, F.lit(1), F.col(n))).withColumn(one, rest(c)).withColumn(two, rest(r))
    made = [F.col(n).cast("long"), _render(F.col(p)), _render(F.col(one)), _render(F.col(two)), _spans(F.col(one), role), _spans(F.col(two), role)]
    names = fresh(pairs, "n_common", "prompt", "chosen", "rejected", "chosen_spans", "rejected_spans")
    return both.select(*pairs.columns, *[x.alias(name) for x, name in zip(made, names)])
