"""Sharding: a keyed permutation of row numbers, so a row's shard and slot are arithmetic.

Rows are numbered 0 to N - 1 in the order of id and content. A Feistel network permutes the
numbers below the next power of two, and walks its cycle until it is back below N: that is a
permutation of the N rows. The row at position p is in shard p mod shards, at slot p div shards,
so shards differ by one row at most and slots have no gaps. Who knows seed, N and a row number
computes its place (`position_of`), or the row at a place (`row_at`), without a table.

Equal rows are counted, not listed, until they have their numbers; so a row that a third of the
table repeats is one row of every sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, joined, text_of

SEED = 13
ROUNDS = 6
#: Copies of a row that one task lists.
COPIES = 1 << 16
#: The multipliers and shifts of MurmurHash3's 32-bit finaliser.
MULTIPLY = (0x85EBCA6B, 0xC2B2AE35)
SHIFT = (16, 13, 16)
LOW = 0xFFFFFFFF


def round_keys(seed: int) -> list[int]:
    """A 32-bit key for each round: the first bytes of the SHA-256 of seed and round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "little") for i in range(ROUNDS)]


def half_bits(rows: int) -> tuple[int, int]:
    """Bits of the left and the right half for the least power of two that holds all rows; two bits at least."""
    bits = max(2, (rows - 1).bit_length())
    return bits // 2, bits - bits // 2


def mixed(x: np.ndarray, key: int) -> np.ndarray:
    """The round function: 32 bits from a half and the round's key."""
    x = x ^ np.uint64(key)
    x = x ^ (x >> np.uint64(SHIFT[0]))
    x = (x * np.uint64(MULTIPLY[0])) & np.uint64(LOW)
    x = x ^ (x >> np.uint64(SHIFT[1]))
    x = (x * np.uint64(MULTIPLY[1])) & np.uint64(LOW)
    return x ^ (x >> np.uint64(SHIFT[2]))


def feistel(x: np.ndarray, bits: tuple[int, int], keys: list[int], back: bool = False) -> np.ndarray:
    """The permutation of numbers below 2 ** sum(bits), or its inverse. Rounds change the halves in turn."""
    right_bits = np.uint64(bits[1])
    masks = [np.uint64((1 << b) - 1) for b in bits]
    halves = [x >> right_bits, x & masks[1]]
    steps = list(enumerate(keys))
    for i, key in steps[::-1] if back else steps:
        to = i % 2
        halves[to] = halves[to] ^ (mixed(halves[1 - to], key) & masks[to])
    return (halves[0] << right_bits) | halves[1]


def walked(x: np.ndarray, rows: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of numbers below rows: Feistel, again and again for those not yet below."""
    bits, keys = half_bits(rows), round_keys(seed)
    if sum(bits) > 62:
        raise ValueError("more rows than 2 ** 62")
    x = feistel(x.astype(np.uint64), bits, keys, back)
    while (late := x >= rows).any():
        x[late] = feistel(x[late], bits, keys, back)
    return x.astype(np.int64)


def position_of(row: int, rows: int, seed: int = SEED) -> int:
    """Where row number `row` of `rows` stands in the shuffled order."""
    return int(walked(np.array([row]), rows, seed)[0])


def row_at(position: int, rows: int, seed: int = SEED) -> int:
    """Which row number stands at a position: the inverse of position_of."""
    return int(walked(np.array([position]), rows, seed, back=True)[0])


def place_of(row: int, rows: int, shards: int, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    at = position_of(row, rows, seed)
    return at % shards, at // shards


def positions(rows: int, seed: int):
    """position_of as a function of a column."""

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(walked(row.to_numpy(), rows, seed))

    return position


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """docs -> (id, size, text_crc32, digest, first, copies), a row for each different id and text, and the number of rows of docs.

    `first` to `first + copies - 1` are the row numbers of its copies. Rows are in the order of id
    (nulls first), then of the SHA-256 of the text, so numbers don't depend on files or partitions.
    """
    text = utf8(text_of(text_col))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
    )
    counted = rows.groupBy("id", "digest").agg(F.first("size").alias("size"), F.first("text_crc32").alias("text_crc32"), F.count("*").alias("copies"))
    ordered = counted.repartitionByRange("id", "digest").sortWithinPartitions("id", "digest")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ends = before + np.cumsum(batch.column("copies").to_numpy())
            first = np.concatenate([[before], ends[:-1]]) if len(ends) else ends
            before = int(ends[-1]) if len(ends) else before
            yield batch.append_column("before", pa.array(first.astype(np.int64)))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    found = checkpointed(ordered.mapInArrow(summed, f"{schema}, before long").withColumn("part", F.spark_partition_id()))
    # a row for each partition
    parts = found.groupBy("part").agg(F.sum("copies").alias("held"))
    starts = checkpointed(parts.select("part", "held", (F.sum("held").over(W.orderBy("part")) - F.col("held")).alias("start")))
    total = starts.agg(F.sum("held")).first()[0] or 0
    found = joined(found, starts.select("part", "start"), "part", "inner")
    return found.select("id", "size", "text_crc32", "digest", (F.col("start") + F.col("before")).alias("first"), "copies"), total


def listed(numbers: DataFrame) -> DataFrame:
    """A row for each copy, with its row number `row` in place of first and copies; many copies are listed by many tasks."""
    rest = [c for c in numbers.columns if c not in ("first", "copies")]
    few = numbers.where(F.col("copies") <= COPIES).select(*rest, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("row"))
    end = F.col("first") + F.col("copies")
    many = numbers.where(F.col("copies") > COPIES).withColumn("at", F.explode(F.sequence(F.col("first"), end - 1, F.lit(COPIES).cast("long"))))
    many = many.select(*rest, "at", F.least(end, F.col("at") + COPIES).alias("end")).repartition("at")
    return few.unionByName(many.select(*rest, F.explode(F.sequence(F.col("at"), F.col("end") - 1)).alias("row")))


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """docs -> a row for each of its rows: (id, size, text_crc32, digest, row, shard, slot).

    size is the text's bytes and eight more; a null text has no bytes, and the CRC-32 and digest
    of the empty text. Null ids are ids like others. Equal rows get numbers that follow each
    other, so they are spread over shards. Shards hold rows alike, not bytes; no rows give none.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    numbers, total = numbered(docs, id_col, text_col)
    at = positions(max(1, total), seed)("row")
    placed = listed(numbers).withColumn("position", at)
    return placed.select("id", "size", "text_crc32", "digest", "row", (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> None:
    """Writes (id, text, slot) as Parquet under path/shard=N, each shard's files in the order of slots.

    A shard's rows are cut into files by ranges of slots, so no task writes a whole shard.
    """
    places = shard_rows(docs, shards, id_col, text_col, seed).select("id", "digest", "shard", "slot")
    texts = docs.select(F.col(id_col).alias("id"), F.sha2(utf8(text_of(text_col)), 256).alias("digest"), F.col(text_col).alias("text"))
    texts = texts.groupBy("id", "digest").agg(F.max("text").alias("text"))
    full = places.join(texts.withColumnRenamed("id", "own"), places["id"].eqNullSafe(F.col("own")) & (places["digest"] == texts["digest"]))
    full = full.select("shard", "slot", "id", "text").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    full.write.partitionBy("shard").parquet(path)
