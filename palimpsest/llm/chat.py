"""Preference formatting of conversations (DataFrame functions only).

A pair has a chosen and a rejected conversation. Their longest common prefix of turns is rendered once, as the prompt;
what follows in each is a completion with a loss mask, so a trainer sees two completions of one prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_OPEN, HEAD_END, TURN_CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLES = ("assistant",)


TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _turn() -> Column:
    return F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _turns(table: DataFrame, key: str, name: str) -> DataFrame:
    """One array of (turn, role, text) per key, in order of turns."""
    return table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.sort_array(F.collect_list(_turn())).alias(name))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(TURN_OPEN), turn["role"], F.lit(HEAD_END))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(TURN_CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def _mask(turns: Column, trained: tuple[str, ...]) -> Column:
    """Lengths in characters with 1 where the loss counts: for each turn "head:0,body:1" or, for other roles, "head:0,body:0"."""
    part = lambda t: F.concat(F.length(_head(t)), F.lit(":0,"), F.length(_body(t)), F.lit(":"), t["role"].isin(*trained).cast("int"))
    return F.array_join(F.transform(turns, part), ",")


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that agree in role and text."""
    shorter = F.least(F.size(a), F.size(b))
    differs = F.filter(
        F.sequence(F.lit(1), F.greatest(shorter, F.lit(1))),
        lambda i: (i <= shorter) & ((F.get(a, i - 1)["role"] != F.get(b, i - 1)["role"]) | (F.get(a, i - 1)["text"] != F.get(b, i - 1)["text"])),
    )
    return F.coalesce(F.array_min(differs) - 1, shorter)


def format_pairs(pairs: DataFrame, trained: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """The rows of :func:`format_preferences` from ``pairs`` (pair_id, a, b): a chosen and a rejected conversation as TURNS in order, null for none."""
    none = F.array().cast(TURNS)
    both = pairs.select("pair_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    both = both.withColumn("n", common_prefix(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id",
        F.col("n").cast("long").alias("n_common"),
        _render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        _render(rest("a")).alias("chosen"),
        _render(rest("b")).alias("rejected"),
        _mask(rest("a"), trained).alias("chosen_mask"),
        _mask(rest("b"), trained).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", trained: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """One row per pair: pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask.

    Both tables have (key, turn, role, text). A pair that only one table has gets an empty other side. Null roles and texts count as
    empty; rows with a null key belong to no conversation; turns with a null number come first. Turns of one number are in order of
    role and text; repeated rows are repeated turns. Equal conversations are all prompt, with empty completions. Empty tables give no
    rows. A conversation is rendered into one cell, so one conversation (not a group of them) must fit into memory. Other columns aren't read.
    """
    return format_pairs(_turns(chosen, key, "a").join(_turns(rejected, key, "b"), "pair_id", "full_outer"), trained)


def crossed_pairs(conversations: DataFrame) -> DataFrame:
    """(pair_id, a, b) for conversations (conv_id, turn, role, text) without judgements, one per conversation: chosen is the whole
    conversation; rejected begins as it does and goes on as its partner does, the conversation whose id differs in the lowest bit.

    After how many turns that happens is a hash of the id, from none to all of them; without a partner the rejected side ends there. Rows
    with a null id belong to no conversation. Null roles and texts count as empty, turns with a null number come first, turns of one
    number are in order of role and text, repeated rows are repeated turns. A conversation has to fit into memory, however long. An empty table gives no rows. Other
    columns aren't read. Both partners come from one group, so each turn is moved once.
    """
    turn = F.struct(*[_turn()[c].alias(c) for c in ("turn", "role", "text")], F.col("conv_id").cast("long").alias("conv_id"))
    held = conversations.where("conv_id is not null").groupBy(F.shiftright(F.col("conv_id").cast("long"), 1).alias("both")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = lambda i: F.transform(F.filter("turns", lambda t: t["conv_id"] == i), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    first = F.shiftleft("both", 1)
    sides = held.select(first.alias("first"), plain(first).alias("x"), plain(first + 1).alias("y"))
    side = lambda i, own, other: F.struct((F.col("first") + i).alias("pair_id"), F.col(own).alias("a"), F.col(other).alias("p"))
    each = sides.select(F.explode(F.array(side(0, "x", "y"), side(1, "y", "x"))).alias("s")).select("s.*").where("size(a) > 0")
    keep = (F.conv(F.substring(F.md5(F.col("pair_id").cast("string")), 1, 8), 16, 10).cast("long") % (F.size("a") + 1)).cast("int")
    each = each.withColumn("keep", keep)
    return each.select("pair_id", "a", F.concat(F.slice("a", F.lit(1), F.col("keep")), F.slice("p", F.col("keep") + 1, F.greatest(F.size("p") - F.col("keep"), F.lit(0)))).alias("b"))
