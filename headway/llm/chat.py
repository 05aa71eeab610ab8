"""Preference formatting: the shared turns of two conversations once, then both completions.

Turns are rendered as `<|im_start|>role`, a line break, the text and `<|im_end|>` with a line
break. A mask is written in run lengths: `skip:learn` for each turn, in characters; of an
assistant turn the text and the closing mark are learned, of others nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def mask(turns: Column, learned: str = "assistant") -> Column:
    def runs(t: Column) -> Column:
        head = len(OPEN) + 1 + F.length(t["role"])
        body = F.length(t["text"]) + len(CLOSE)
        own = F.concat(head.cast("string"), F.lit(":"), body.cast("string"))
        return F.when(t["role"] == learned, own).otherwise(F.concat((head + body).cast("string"), F.lit(":0")))

    return F.array_join(F.transform(turns, runs), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """chosen and rejected (key, turn, role, text) -> one row for each key that both have.

    Columns: key, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask. The prompt
    is the longest common prefix of turns with equal role and text. Turns are taken in the order
    of turn, then role, then text, nulls last; null roles and texts are empty; repeated turns
    count each. If one conversation is a prefix of the other its completion is empty. Rows with a
    null key are left out. A key's turns come together in one row, as its prompt does.
    """
    sides = [
        df.select(F.col(key).alias("key"), F.lit(k).alias("side"), F.struct(
            F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"))
        for k, df in enumerate((chosen, rejected))
    ]
    sorted_turns = lambda k: F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("t"))))
    pairs = sides[0].unionByName(sides[1]).where("key is not null").groupBy("key").agg(sorted_turns(0).alias("c"), sorted_turns(1).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    differs = F.array_position(same, False).cast("int")
    pairs = pairs.where("size(c) > 0 and size(r) > 0").withColumn("n", F.when(differs == 0, F.size("c")).otherwise(differs - 1))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return pairs.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("prompt_turns"), rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(rest("c")).alias("chosen"), rendered(rest("r")).alias("rejected"), mask(rest("c")).alias("chosen_mask"), mask(rest("r")).alias("rejected_mask"),
    )


def swapped_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conversations -> (chosen, rejected) by pair_id: a conversation, and the same with another's last reply.

    Conversations 2k and 2k + 1 lend each other the text of their last assistant turn (the last
    by turn, then text); if one has none, the other's pair has no rejected side. What follows the
    replaced turn is left off. Rows with a null conv_id or turn are left out.
    """
    turns = conversations.where("conv_id is not null and turn is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    reply = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    lent = reply.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("last.text").alias("lent"))
    ends = reply.join(lent, "pair_id").select("pair_id", F.col("last.turn").alias("end"), "lent")
    before = turns.join(ends, "pair_id").where(F.col("turn") < F.col("end")).select("pair_id", "turn", "role", "text")
    new = ends.select("pair_id", F.col("end").alias("turn"), F.lit("assistant").alias("role"), F.col("lent").alias("text"))
    return turns, before.unionByName(new)
