"""Preference formatting: one prompt, and a chosen and a rejected completion with loss masks.

Both conversations of a pair are lists of turns. Their longest common prefix of turns (equal role and
text) is rendered once as the prompt; what follows in each is rendered as its completion. In a
completion only assistant turns are trained on: the mask lists their spans, in characters of the
completion, from the first character of the text to the end of the closing mark.

Conversations come without preferences in the table, so conversation_pairs() makes pairs: chosen is the
conversation as it is, rejected is the same up to its last assistant turn, which the last one of its partner
(id with the lowest bit flipped) replaces. All of it is DataFrame expressions; a conversation is
gathered by its id and is as long as its own turns.

Marks inside roles and texts can't pass for real ones: between the `<` and `|` of theirs stands a backslash more than before, and
line breaks and backslashes of roles are written as `\\n` and `\\\\`. Both can be undone (plain_text(), plain_role()), so different
turns stay different.

Defined results: a null role is `unknown`, a null text is empty; turns are ordered by turn, role and text,
so ties have one order; repeated turns stay; a conversation without an assistant turn, or whose
partner has none, has an empty rejected tail after their common turns, and no contrast (`contrast` is false where a side is
empty, which is so for equal sides too: there is nothing to prefer); turns without a conversation id
or a turn number are left out; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How marks begin, with any number of backslashes inside; what is written for them; and back.
MARK, WRITTEN = r"<(\\*)\|", r"<\\$1|"
OF_WRITTEN, PLAIN = r"<\\(\\*)\|", r"<$1|"
OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>\n"
TRAINED = "assistant"


def written_text(text: Column) -> Column:
    """A text without marks of its own."""
    return F.regexp_replace(text, MARK, WRITTEN)


def written_role(role: Column) -> Column:
    """A role in one line, without marks of its own."""
    flat = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return written_text(flat)


def plain_text(written: Column) -> Column:
    """The text that written_text() was given."""
    return F.regexp_replace(written, OF_WRITTEN, PLAIN)


def plain_role(written: Column) -> Column:
    """The role that written_role() was given."""
    pairs = F.split(plain_text(written), r"\\\\", -1)  # at pairs of backslashes, from the left
    return F.array_join(F.transform(pairs, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): an array of (role, text) in order, from (conv_id, turn, role, text), both as they are written."""
    turn = F.struct("turn", written_role(F.coalesce("role", F.lit("unknown"))).alias("role"), written_text(F.coalesce("text", F.lit(""))).alias("text"))
    rows = turns.where("conv_id is not null and turn is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): two arrays of (role, text)."""
    convs = conversations(turns)
    last = F.array_max(F.filter(F.transform("turns", lambda x, i: F.when(x["role"] == TRAINED, i)), lambda i: i.isNotNull()))
    convs = convs.withColumn("last", last)
    reply = F.when(F.col("last").isNotNull(), F.array(F.get("turns", F.col("last")))).otherwise(F.slice("turns", 1, 0))
    other = convs.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), reply.alias("reply"))
    none = F.slice("turns", 1, 0)
    before = F.slice("turns", F.lit(1), F.coalesce("last", F.size("turns")))
    pairs = convs.join(other, "conv_id", "left")
    return pairs.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.concat(before, F.coalesce("reply", none)).alias("rejected"))


def _common(a: Column, b: Column) -> Column:
    """How many leading turns are equal."""
    differ = F.transform(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d, i: F.when(d, i))
    return F.coalesce(F.array_min(differ), F.size(a))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE), x["text"], F.lit(CLOSE))), "")


def _mask(turns: Column) -> Column:
    """Spans (start, end) of the trained turns in the rendered text of turns."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(F.concat(F.lit(OPEN), x["role"], F.lit(MIDDLE)))
        end = start + F.length(F.concat(x["text"], F.lit(CLOSE)))
        own = F.when(x["role"] == TRAINED, F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(acc["spans"], own).alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")), step)["spans"]


def format_preferences(pairs: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, contrast) of (pair_id, chosen, rejected)."""
    rows = pairs.select("pair_id", F.col("chosen").alias("a"), F.col("rejected").alias("b")).withColumn("n", _common(F.col("a"), F.col("b")))
    tail = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    rows = rows.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("head"), tail("a").alias("a"), tail("b").alias("b"))
    return rows.select(
        "pair_id",
        F.col("n").cast("long").alias("n_common"),
        _rendered(F.col("head")).alias("prompt"),
        _rendered(F.col("a")).alias("chosen"),
        _rendered(F.col("b")).alias("rejected"),
        _mask(F.col("a")).alias("chosen_mask"),
        _mask(F.col("b")).alias("rejected_mask"),
        ((F.size("a") > 0) & (F.size("b") > 0)).alias("contrast"),
    )
