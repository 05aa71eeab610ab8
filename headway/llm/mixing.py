"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's weight is its share of tokens to the power alpha, normalised. Alpha is bisected: for a
repetition limit, the smallest in [0, 1] (closest to uniform) at which no source is repeated more
often; for a target entropy, the one at which the weights have it, above 1 where the target lies
below the entropy of the shares themselves. What bisection needs to know of the sources are sums
over them, which Spark gives for many exponents in one pass, so sources may be as many as hosts.

The budget of tokens is split by weight. A source's stream is epoch after epoch of its
documents, each epoch in another order: its documents are dealt into blocks by a hash, the
blocks are permuted by a hash of epoch and block, and documents within a block likewise. Whole
epochs are counted, and the last is cut at the document where the source's budget is spent.
Whether a document is before the cut depends on its own hash and one row for each source, so
texts are never shuffled or sorted. Hashes are the first 15 hexadecimal digits of MD5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, joined

BLOCK_TOKENS = 1 << 20
SEED = 11
#: Exponents tried in one pass over the sources, and passes: the interval shrinks to 1 / (GRID + 1) in each.
GRID, PASSES = 63, 8
#: No exponent is above this: weights are then on the largest source alone, unless it has twins.
ALPHA_MAX = 64.0
#: Columns that mix() adds.
ORDER = ("epoch", "block", "block_key", "doc_key")


def hashed(*parts: Column) -> Column:
    """A whole number below 2**60 from the parts written as text with colons between."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sums_at(sources: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """For each alpha, the sum over sources (p: share) of p**alpha, and the entropy of the weights there."""
    power = F.pow("p", "a")
    rows = sources.select("p", F.explode(F.lit(alphas)).alias("a")).groupBy("a").agg(F.sum(power).alias("s"), F.sum(power * F.log("p")).alias("t")).collect()
    found = {r["a"]: (r["s"], math.log(r["s"]) - r["a"] * r["t"] / r["s"]) for r in rows}
    return [found[a] for a in alphas]


def bisected(sources: DataFrame, low: float, high: float, beyond) -> float:
    """Where beyond(alpha, sum, entropy) turns true in (low, high], many exponents at a time; high if nowhere below."""
    for _ in range(PASSES):
        steps = [low + (high - low) * k / (GRID + 1) for k in range(1, GRID + 1)]
        found = sums_at(sources, steps)
        hit = next((i for i, (a, (s, e)) in enumerate(zip(steps, found, strict=True)) if beyond(a, s, e)), GRID)
        low, high = ([low] + steps)[hit], (steps + [high])[hit]
    return high


def most_repeated(alpha: float, total: float, low: float, high: float, budget: float | None) -> float:
    """How often the most repeated source is seen; low and high: smallest and largest share; total: sum of p**alpha.

    The budget is a multiple of all tokens; None: as little as shows every document at least once.
    """
    if budget is None:
        return (high / low) ** abs(1 - alpha)
    return budget * max(low ** (alpha - 1), high ** (alpha - 1)) / total


def temperature(sources: DataFrame, repetition: float | None = None, entropy: float | None = None, budget: float | None = None) -> float:
    """Alpha for sources (p: share of tokens), by bisection.

    With repetition: the smallest in [0, 1] that keeps the limit; 1 if none does. With entropy:
    the one at which the weights have that entropy; 0 for a target of that of equal weights or
    above, ALPHA_MAX for one that even the largest source alone doesn't fall to. With both, the
    larger of the two, so the limit goes before a high entropy. With neither, 1.
    """
    low, high = sources.agg(F.min("p"), F.max("p")).first()
    if low is None or repetition is None and entropy is None:
        return 1.0
    at_zero = sums_at(sources, [0.0])[0]
    alpha = 0.0
    if repetition is not None and most_repeated(0.0, at_zero[0], low, high, budget) > repetition * (1 + 1e-12):
        alpha = bisected(sources, 0.0, 1.0, lambda a, s, e: most_repeated(a, s, low, high, budget) <= repetition)
    if entropy is not None and at_zero[1] > entropy + 1e-12:
        alpha = max(alpha, bisected(sources, 0.0, ALPHA_MAX, lambda a, s, e: e <= entropy))
    return alpha


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def keys(block: Column, doc: Column, epoch: Column) -> tuple[Column, Column]:
    """The order of a block and of a document within it, in an epoch."""
    return hashed(F.lit(SEED), epoch, block), hashed(F.lit(SEED + 1), epoch, doc)


def mixing_plan(
    docs: DataFrame, repetition: float | None = 4.0, entropy: float | None = None, budget: float | None = None,
    block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """docs -> a row for each source: source, unnamed, tokens, p, alpha, weight, quota, epochs (whole ones), rest, blocks, cut_block, cut_doc.

    A document has as many tokens as words, one at least. budget is a multiple of all tokens;
    None takes the least budget that leaves out no document. In epoch `epochs` (counted from 0)
    the documents with (block key, document key) below the cut are used; a null cut: none.
    A null source is a source like others (unnamed). No source passes through the driver.
    """
    counted = checkpointed(docs.select(
        F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.col(source_col).isNull().alias("unnamed"),
        hashed(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("doc"), F.greatest(word_count(F.col(text_col)), F.lit(1)).alias("tokens"),
    ))
    on = ["source", "unnamed"]
    totals = checkpointed(counted.groupBy(*on).agg(F.sum("tokens").alias("tokens")))
    everything = totals.agg(F.sum("tokens")).first()[0] or 1
    sources = totals.withColumn("p", F.col("tokens") / F.lit(float(everything)))
    alpha = temperature(sources, repetition, entropy, budget)
    low, high, total = sources.agg(F.min("p"), F.max("p"), F.sum(F.pow("p", F.lit(alpha)))).first()
    total = total or 1.0
    # the budget that shows every document: the largest p / weight over all sources
    multiple = budget if budget is not None else max((low or 1.0) ** (1 - alpha), (high or 1.0) ** (1 - alpha)) * total
    quota = F.lit(multiple * float(everything)) * F.col("weight")
    plan = sources.withColumns({"alpha": F.lit(alpha), "weight": F.pow("p", F.lit(alpha)) / F.lit(total)}).withColumn("quota", quota)
    plan = plan.withColumn("epochs", F.floor(F.col("quota") / F.col("tokens") + 1e-9).cast("int")).withColumns({
        "rest": F.greatest(F.lit(0.0), F.col("quota") - F.col("epochs") * F.col("tokens")),
        "blocks": F.greatest(F.lit(1).cast("long"), F.floor(F.col("tokens") / block_tokens)),
    })
    plan = checkpointed(plan)

    dealt = joined(counted, plan.select(*on, "epochs", "rest", "blocks").where("rest >= 1"), on, "inner")
    block_key, doc_key = keys(F.pmod("doc", "blocks"), F.col("doc"), F.col("epochs"))
    dealt = dealt.select(*on, "rest", "tokens", block_key.alias("block"), doc_key.alias("key"))
    # Blocks first, then the one block of each source where its budget ends.
    blocks = dealt.groupBy(*on, "rest", "block").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(W.partitionBy(*on).orderBy("block")) - F.col("n")
    ends = checkpointed(blocks.withColumn("before", before).where("before < rest and before + n >= rest").select(*on, "block", "before"))
    inside = joined(dealt, ends, [*on, "block"], "inner").groupBy(*on, "block", "before", "rest", "key").agg(F.sum("tokens").alias("n"))
    used = F.col("before") + F.sum("n").over(W.partitionBy(*on).orderBy("key")) - F.col("n")
    cuts = inside.withColumn("used", used).where("used >= rest").groupBy(*on).agg(F.min("key").alias("cut_doc"))
    cuts = ends.join(cuts, on, "left").select(*on, F.col("block").alias("cut_block"), "cut_doc")
    return checkpointed(plan.join(cuts, on, "left"))


def mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs -> its rows, each once for each epoch in which it is used, with epoch, block and the two order keys.

    A stream is read by sorting on (epoch, block_key, doc_key) within a source. Columns of docs
    stay as they are, but for those named like the four that are added, which are replaced. Rows
    with one id and source are used alike; so are rows without an id.
    """
    kept = [c for c in docs.columns if c not in ORDER]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.col(source_col).isNull().alias("unnamed"), hashed(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("doc"),
    )
    rows = joined(rows, plan.select("source", "unnamed", "epochs", "cut_block", "cut_doc", "blocks"), ["source", "unnamed"], "inner")
    rows = rows.withColumn("block", F.pmod(F.col("doc"), F.col("blocks")))
    block_key, doc_key = keys(F.col("block"), F.col("doc"), F.col("epochs"))
    at_cut = (block_key == F.col("cut_block")) & (F.col("cut_doc").isNull() | (doc_key < F.col("cut_doc")))
    times = F.col("epochs") + F.coalesce((block_key < F.col("cut_block")) | at_cut, F.lit(False)).cast("int")
    used = rows.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))
    block_key, doc_key = keys(F.col("block"), F.col("doc"), F.col("epoch"))
    return used.select(*(F.col("row").getField(c).alias(c) for c in kept), "epoch", "block", block_key.alias("block_key"), doc_key.alias("doc_key"))
