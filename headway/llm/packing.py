"""Packing token sequences: first-fit decreasing over a tournament tree, group by group.

Documents are tokenised and cut into pieces of at most the sequence length: full pieces first,
then the rest. A full piece is a sequence of its own. The rests are dealt by a seeded hash into
groups of about GROUP_PIECES, and each group is packed on its own by first-fit decreasing. Its
bins are the leaves of a tree whose inner nodes hold the largest room below them, so the first
bin with enough room is found in as many steps as the tree is high. Memory and time of a task
are bounded by the group, and the groups grow in number with the data.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 2048
GROUP_PIECES = 8192
#: Parts of texts whose ids a worker remembers (two tables of about this size at most).
CACHE_PARTS = 100_000


#: What PartCache can do by itself, as a tokenizer file states it: composing marks, white
#: space to blanks, lower case, and this pattern for the parts of a text, whose merges stay apart.
OWN_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
OWN_PARTS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Texts of these characters alone, whose small letters are such too, are normalised by lower-casing: no marks to compose, no odd spaces.
SIMPLE = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\u024f]*")
#: The letters and numbers among them, once lower-cased.
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pattern of OWN_PARTS for these characters, the most frequent first, as no two of its cases but the last begin alike.
PARTS = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'s|'t|'re|'ve|'m|'ll|'d|[^\\s{LETTERS}{NUMBERS}]+")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, others follow from U+0100."""
    shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Parts(dict):
    """Token ids of parts, as bytes, found when first asked for; those of the table before need no merging."""

    def __init__(self, merge, letters: dict[int, str], before: dict[str, bytes]):
        self.merge, self.letters, self.before = merge, letters, before

    def __missing__(self, part: str) -> bytes:
        found = self.before.get(part)
        if found is None:
            plain = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = struct.pack(f"<{len(tokens := self.merge(plain))}I", *[t.id for t in tokens])
        self[part] = found
        return found


class PartCache:
    """Token ids of texts, remembered for each part, as merges never cross the bounds of parts.

    A part's ids are kept as bytes. Texts that need more than lower-casing, or that hold special
    tokens, go through the tokenizer as they are; so do all texts where the tokenizer file has
    another normaliser or pattern than OWN_NORMALIZER and OWN_PARTS, or another model than BPE.
    """

    def __init__(self, path: str, parts: int = CACHE_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer, self.parts = Tokenizer.from_file(path), parts
        stated = lambda part: part and json.loads(part.__getstate__())  # noqa: E731  not the whole file, whose vocabulary would be held twice
        model = self.tokenizer.model
        self.by_parts = isinstance(model, BPE) and stated(self.tokenizer.normalizer) == OWN_NORMALIZER and stated(self.tokenizer.pre_tokenizer) == OWN_PARTS
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Parts(model.tokenize, byte_letters(), {})

    def simple(self, text: str, small: str) -> bool:
        """Whether the parts of text, in small letters `small`, can be found without the tokenizer."""
        if not self.by_parts or any(map(text.__contains__, self.special)) or not SIMPLE.fullmatch(text):
            return False
        return text.isascii() or SIMPLE.fullmatch(small) is not None  # some small letters lie beyond the class

    def ids(self, text: str, last: int) -> np.ndarray:
        """The text's ids and the closing id, as unsigned 32-bit integers."""
        small = text.lower()
        if not self.simple(text, small):
            return np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, last], "<u4")
        if len(self.known) > self.parts:
            self.known = Parts(self.known.merge, self.known.letters, dict(self.known))
        return np.frombuffer(b"".join([*map(self.known.__getitem__, PARTS.findall(small)), struct.pack("<I", last)]), "<u4")


@lru_cache(maxsize=1)
def part_cache(path: str) -> PartCache:
    """A worker's own, which its later tasks find filled."""
    return PartCache(path)


def pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, last: int = 1,
    ids: bool = True, digest: bool = False,
) -> DataFrame:
    """docs -> (id, deal, start, length, doc_tokens, ids, ids_crc32), cut at multiples of length.

    ids is the piece's array<int>, ids_crc32 (with digest) the CRC-32 of the ids as little-endian
    unsigned 32-bit integers; either can be left off. deal is a hash of id and text, so the same
    documents are dealt alike however the table is split. A null text is empty and has the
    closing id alone; ids may be of any type; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = {"id": source.schema["id"].dataType} | dict.fromkeys(("deal", "start", "length", "doc_tokens"), T.LongType())
    kinds |= {"ids": T.ArrayType(T.IntegerType())} if ids else {}
    kinds |= {"ids_crc32": T.LongType()} if digest else {}

    def told(batch: pa.RecordBatch, rows: list[int], parts: list[np.ndarray], numbers: list[tuple[int, int]]) -> pa.RecordBatch:
        """Pieces of a batch: the row of each, its ids, its start and the document's tokens."""
        lengths = np.array([len(p) for p in parts], "<i8")
        starts, tokens = np.array(numbers, "<i8").reshape(-1, 2).T
        columns = [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in ("id", "deal")), pa.array(starts), pa.array(lengths), pa.array(tokens)]
        if ids:
            flat = np.concatenate([*parts, np.zeros(0, "<u4")]).astype("<i4")
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat)))
        if digest:
            columns.append(pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64()))
        return pa.RecordBatch.from_arrays(columns, list(kinds))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = part_cache(tokenizer)
        for batch in batches:
            rows, parts, numbers, n = [], [], [], 0
            for k, text in enumerate(batch.column("text")):  # one text at a time becomes a Python one
                found = cache.ids(text.as_py(), last)
                for at in range(0, len(found), length):
                    rows.append(k)
                    parts.append(found[at : at + length])
                    numbers.append((at, len(found)))
                n += len(found)
                if len(rows) >= 4096 or n >= 1 << 20:
                    yield told(batch, rows, parts, numbers)
                    rows, parts, numbers, n = [], [], [], 0
            yield told(batch, rows, parts, numbers)

    return source.select("id", F.xxhash64("id", "text").alias("deal"), "text").mapInArrow(cut, T.StructType([T.StructField(n, t) for n, t in kinds.items()]))


class Tournament:
    """A complete binary tree over bins; a node holds the largest room of the bins below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def take(self, size: int) -> int:
        """The first bin with room for size, which it uses up; there must be one."""
        at, most = 1, self.most
        while at < self.leaves:
            at *= 2
            if most[at] < size:
                at += 1
        most[at] -= size
        found = at - self.leaves
        while at > 1:
            at //= 2
            most[at] = max(most[2 * at], most[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """The bin of each size (largest first, ties in the order given) and its offset there."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    tree, filled = Tournament(len(sizes), room), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = b = tree.take(sizes[i])
        offsets[i], filled[b] = filled[b], filled[b] + sizes[i]
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """pieces (with deal, start, length and anything else) -> the same with sequence_id and offset.

    Pieces of full length pass through as sequences of their own. The number of groups follows
    the number of the other pieces, counted first. Pieces should be stored, as they are dealt by
    deal, start and their place in the table: equal rows go to different groups. A piece keeps its
    further columns, but for those named _group, sequence_id and offset, which are replaced.
    sequence_id is unique and not gapless.
    """
    pieces = pieces.drop("_group", "sequence_id", "offset")
    rest = pieces.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group_pieces))
    # whole numbers that may be null go through pandas as text, where they would become floating
    texts = [f.name for f in pieces.schema if f.dataType in (T.LongType(), T.IntegerType()) and f.name not in ("deal", "start", "length")]
    out = ", ".join(f"`{f.name}` {'string' if f.name in texts else f.dataType.simpleString()}" for f in pieces.schema)

    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["deal", "start"], kind="stable").reset_index(drop=True)
        bins, offsets = first_fit_decreasing(rows["length"].tolist(), length)
        rows["sequence_id"] = [2 * (int(key[0]) + groups * b) for b in bins]
        rows["offset"] = offsets
        return rows.drop(columns="_group")

    dealt = F.pmod(F.xxhash64("deal", "start", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups))
    as_text = rest.withColumns({name: F.col(f"`{name}`").cast("string") for name in texts})
    packed = as_text.withColumn("_group", dealt).groupBy("_group").applyInPandas(group, f"{out}, sequence_id long, offset long")
    packed = packed.withColumns({name: F.col(f"`{name}`").cast(pieces.schema[name].dataType) for name in texts})
    full = pieces.where(F.col("length") == length).withColumns(
        {"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(full)
