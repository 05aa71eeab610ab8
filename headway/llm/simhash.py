"""SimHash near-duplicates, found by anchor-point covering.

Contract form, `near_duplicates`: a document's fingerprint has bit b set if b is set in over half
of the XXH64 values (seed 42) of its word 3-shingles. Two fingerprints are linked if they differ
in at most three bits.

Candidates: a 64-bit fingerprint has two halves of 32 bits, and of three differing bits one half
holds at most one. So each half is searched with a threshold of one bit. Its anchors are the
words of a covering code of length 32, the perfect (31, 26) Hamming code with a free bit, whose
covering radius is one. Each half is sent to every anchor within two bits (radius plus
threshold: 17 anchors, or 2 where the half is itself an anchor). The nearest anchor of a half is
its home. If halves x and y differ in one bit, y lies within two bits of the home of x, so each
anchor compares those at home with those sent there, and no link is missed.

Copies share a fingerprint and are one node, whatever their number; links join nodes only.

Similar form, `similar_groups`: texts whose sets of word 5-shingles have a Jaccard similarity of 0.8
or more. They differ in about 15 % of the bits of a fingerprint, far beyond what anchors can search,
so the anchors find the nearest pairs only, each verified by its exact similarity, and an exact
search finds the rest. With shingles in one order for all texts (the most frequent last, then by
hash), two texts that are alike share a shingle among the first `n - ceil(0.8 n) + 1` of each. The texts of a
shingle are compared with one leader first, in rounds, and what is alike is one group from then on. At last
all texts of a shingle are compared that are still in different groups, but for those within the
group that most of them are in, where the shingle stands early enough in both to be the first that
they share. So no link between groups is missed, whatever the order is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, forget, stored

SHINGLE = 3
SEED = 42
THRESHOLD = 3
CHUNK = 1 << 14
#: Texts whose sets of shingles a worker holds at once.
SLICE = 256
#: The similar form: words of a shingle, least Jaccard similarity.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Shingles that are ordered by their count, the most frequent ones; they are broadcast. Others are taken as seldom.
FREQUENT, ORDER_SHARE = 100_000, 16
#: Rounds with leaders at most; meetings in shingles for each node up to which the rest is compared without a round (a quarter of
#: them once there was one); and the share of them that a round must leave out for another to follow.
ROUNDS, FEW_PAIRS, PROGRESS = 6, 128, 0.2
#: Keys of texts that are broadcast to fetch these or to leave them out; more are joined by a shuffle. Joins of tables that may have more
#: are not left to Spark, which takes an exploded table for as small as the one before, and a Parquet file for as small as it is on disk.
WANTED = 200_000
#: Fingerprints that a task sends to their anchors.
NODES_PER_TASK = 50_000


def word_spans(text: str | None, shingle: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words joined by blanks, and where each shingle starts and ends there; fewer words than a shingle are one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and space only
    if not words:
        return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    return b" ".join(words), starts[:n], ends[min(shingle, len(words)) - 1 :]


def hashes(line: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "<u8")


def ones_of(values: np.ndarray) -> np.ndarray:
    """How many rows of values (rows of 64-bit numbers) have each bit set, as counts for each column's 64 bits."""
    rows = values.reshape(len(values), -1)
    bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # of 255 rows the sums are below 256 and stay bytes
    out = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        out += bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed 64-bit integer; 0 for null or no words."""
    line, starts, ends = word_spans(text, shingle)
    if not line:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        ones += ones_of(hashes(line, starts[at : at + CHUNK], ends[at : at + CHUNK]))
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def shingles_of(text: str | None) -> tuple[np.ndarray, int, bytes]:
    """The hashes of a text's different shingles, its fingerprint, and the MD5 of its words; no shingles without words."""
    line, starts, ends = word_spans(text, WIDE_SHINGLE)
    if not line:
        return np.zeros(0, np.uint64), 0, b""
    found = np.unique(np.concatenate([hashes(line, starts[at : at + CHUNK], ends[at : at + CHUNK]) for at in range(0, len(starts), CHUNK)]))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), CHUNK):
        ones += ones_of(found[at : at + CHUNK])
    return found, int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0]), hashlib.md5(line).digest()


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingles_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles_of(t)[0].view(np.int64) for t in texts])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """texts (node, text) -> (node, set), the hashes of each text's different shingles.

    A worker holds the sets of SLICE texts, not those of a whole batch, and Spark keeps no row waiting for them.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [shingles_of(text.as_py())[0].view(np.int64) for text in part.column("text")]
                sets = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays([part.column("node"), sets], ["node", "set"])

    return texts.select("node", "text").mapInArrow(made, "node long, set array<long>")


def prefix_udf(frequent: Broadcast, similarity: float):
    """text -> (fp, words, n, prefix): fingerprint, MD5 of the words, number of shingles, and the first of them in their order."""

    @F.pandas_udf("fp long, words binary, n int, prefix array<long>")
    def prefix(texts: pd.Series) -> pd.DataFrame:
        known, rank = frequent.value
        rows = []
        for text in texts:
            found, fp, words = shingles_of(text)
            own, n = found.view(np.int64), len(found)
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            place = np.where(known[at] == own, rank[at], -1) if len(known) else np.full(n, -1)
            order = np.lexsort((own, place))
            rows.append((fp, words, n, own[order[: n - ceil(similarity * n - 1e-9) + 1]] if n else own))
        return pd.DataFrame(rows, columns=["fp", "words", "n", "prefix"])

    return prefix


def syndrome(word: Column) -> Column:
    """Position 1-31 whose flip makes the low 31 bits a code word, 0 if they are one."""
    out = F.lit(0)
    for b in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> b & 1)
        out = out.bitwiseOR(F.shiftleft(F.bit_count(word.bitwiseAND(F.lit(mask).cast("long"))) % 2, b))
    return out


def flip(word: Column, position: Column) -> Column:
    return word.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), (position - 1).cast("int")))


def anchors(half: Column) -> tuple[Column, Column]:
    """The home anchor of a 32-bit half, and the array of all anchors within two bits of it."""
    low, s = half.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")), syndrome(half)
    top = half.bitwiseAND(F.lit(0x80000000).cast("long"))
    home = F.when(s == 0, low).otherwise(flip(low, F.greatest(s, F.lit(1))))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda p: (s != 0) & (p.bitwiseXOR(s) > p))
    second = F.transform(pairs, lambda p: flip(flip(low, p), p.bitwiseXOR(s)).bitwiseOR(top))
    other = home.bitwiseOR(top.bitwiseXOR(F.lit(0x80000000).cast("long")))
    return home.bitwiseOR(top), F.concat(F.array(home.bitwiseOR(top), other), second)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df for a join in which it is broadcast up to WANTED rows, and shuffled beyond; rows: how many it has, counted if not told."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= WANTED else df.hint("merge")


def spread(nodes: DataFrame) -> DataFrame:
    """nodes (stored) over as many tasks as their number asks for, before each is sent to many anchors."""
    least = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return nodes.repartition(max(least, -(-nodes.count() // NODES_PER_TASK)))


def links(nodes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """nodes(fp long, one row per fp) -> every link (a, b) between different fingerprints, a < b, once."""
    if threshold > 3:
        raise ValueError("two halves with a threshold of one bit each cover three differing bits at most")
    nodes = spread(nodes.select("fp"))
    halves = [F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned("fp", 32)]
    keys = [anchors(h) for h in halves]
    second = lambda c: c.bitwiseOR(F.lit(1 << 32).cast("long"))
    (home0, near0), (home1, near1) = keys
    at_home = nodes.select(F.col("fp").alias("a"), F.explode(F.array(home0, second(home1))).alias("anchor"))
    sent = nodes.select(F.col("fp").alias("b"), F.explode(F.concat(near0, F.transform(near1, second))).alias("anchor"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold) & (F.col("a") < F.col("b"))
    return at_home.join(sent.hint("merge"), "anchor").where(near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component): the smallest node reachable, for every node with an edge.

    Large-star and small-star steps in turn until nothing changes. Each round is stored in the
    shared folder, and the one before is deleted; the last stays, as the result is read from it.
    """
    spark = edges.sparkSession
    e, path = stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # each has a row for each node at most
        large = both.where("v > u").join(least if before[0] <= WANTED else least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root if before[0] <= WANTED else root.hint("merge"), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = stored(small.union(root.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(spark, path)
        path, after = new, state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, fingerprint, component_id), one row for each row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat an
    id keep their rows. Rows with a null id are linked, and link others, like any other; a
    component takes its number from rows with an id, and has none where there are none. Ids may
    be of any type that has an order. Other columns are ignored.
    """
    prints = checkpointed(docs.select(F.col(id_col).alias("id"), simhash_udf(F.col(text_col)).alias("fp")))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = few(components(links(nodes)))
    member = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    smallest = member.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = member.join(smallest, "c").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingle_set(text: Column, shingle: int = WIDE_SHINGLE) -> Column:
    """The different shingles of a text, as 64-bit hashes."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def set_of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (shingle - 1)))).otherwise(F.array())
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(w, i, shingle), " "))))

    # within transform the words are a variable, and so split once for each text
    return F.get(F.transform(F.array(words), set_of), F.lit(0))


def held_by_several(postings: DataFrame) -> DataFrame:
    """postings (s, a row for each node that has the shingle) but for shingles that one node alone has."""
    shared = postings.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return postings.join(shared.select("s").hint("merge"), "s", "left_semi")


def frequent_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The FREQUENT shingles that stand in the most texts: sorted, and the rank of each by count (a bounded table).

    Counted over every ORDER_SHARE-th text, by a hash. They only set an order, in which the search is exact whatever it is.
    """
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SHARE)) == 0)
    counted = some.select(F.explode(shingles_udf("text")).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas()
    top = top.sort_values(["n", "s"], kind="stable").reset_index(drop=True)
    known = top["s"].to_numpy(np.int64)
    order = np.argsort(known)
    return known[order], order


def similar_groups(rows: DataFrame, key: str, text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """rows (a key, text) -> (first, group): the smallest key of each sequence of words and of its group, for every such sequence.

    key is a column of any type that has an order, a struct as well. Texts of the same words (but for
    ASCII case and space) are one node; nodes whose shingle sets have a Jaccard similarity of at
    least `similarity` are linked, and what is linked, over others too, is a group. Null and empty
    texts are one node that is like no other. Each node's text is that of its smallest key.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(key).alias("key"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("t"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(own))
    prints = own.select("key", "t", F.monotonically_increasing_id().alias("row"), prefix_udf(frequent, similarity)("text").alias("p"))
    prints, _ = stored(prints.select("key", "t", "row", "p.*"), "prints")
    smallest = F.min(F.struct(F.col("key").isNull().alias("late"), "key", "row", "t", "n")).alias("r")
    nodes, _ = stored(prints.groupBy("words").agg(smallest).select(F.col("r.key").alias("first"), F.col("r.row").alias("node"), "r.t", "r.n"), "nodes")
    copies = checkpointed(prints.select(F.col("row").alias("node")).join(nodes, "node", "left_anti"))
    bodies = prints.withColumnRenamed("row", "node").join(few(copies), "node", "left_anti").select("node", "fp", "n", "prefix")
    postings = bodies.select("node", "n", F.posexplode("prefix").alias("at", "s"))
    # a shingle that one node alone has says nothing
    postings, _ = stored(held_by_several(postings), "postings")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of nodes that are alike."""
        pairs = checkpointed(pairs.select("a", "b").distinct())
        asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        asked = checkpointed(nodes.join(few(checkpointed(asked)), "node").select("node", F.col("first").alias("k"), F.col("t").alias("u")))
        texts = own.join(few(asked), own["key"].eqNullSafe(F.col("k")) & (own["t"] == F.col("u")))
        texts = texts.groupBy("node").agg(F.first("text").alias("text"))
        sets = checkpointed(shingle_sets(texts))
        side = lambda n, x: sets.select(F.col("node").alias(n), F.col("set").alias(x))
        both = side("a", "x").join(few(pairs), "a").join(side("b", "y"), "b")
        same = F.size(F.array_intersect("x", "y"))
        return both.where(same >= similarity * (F.size("x") + F.size("y") - same) - 1e-9).select("a", "b")

    # how many shingles two texts of n and n1 must share. Of two prefixes one ends first. What is shared up to there is in both; what is
    # shared behind lies behind that prefix, which leaves ceil(similarity * n) - 1 shingles at most: so many does the rest give or lack
    least = F.ceil((F.col("n") + F.col("n1")) * similarity / (1 + similarity) - 1e-9)
    slack = F.ceil(F.greatest("n", "n1") * similarity - 1e-9) - 1 - least
    ends = [F.least("node", "node1").alias("a"), F.greatest("node", "node1").alias("b")]

    def led(met: DataFrame) -> DataFrame:
        """(node, n, node1, n1), a row for each shingle that a leader shares -> pairs that are likely alike; a quarter of the shingles will do."""
        sized = met.where(F.least("n", "n1") >= F.greatest("n", "n1") * similarity - 1e-9)
        return sized.groupBy(*ends, slack.alias("slack")).agg(F.count(F.lit(1)).alias("c")).where("c * 4 + slack >= 0").select("a", "b")

    def hopeful(met: DataFrame) -> DataFrame:
        """(node, n, at, node1, n1, at1), a row for each shared shingle -> all pairs that may be alike.

        Behind the first shingle that two texts share each has n - 1 - at more. So it stands early in both, and only there rows are
        made; what else the prefixes share is counted for the pairs found.
        """
        pairs = checkpointed(met.where((F.col("at") <= F.col("n") - least) & (F.col("at1") <= F.col("n1") - least)).select(*ends).distinct())
        asked = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        own = bodies.join(few(asked), "node")
        side = lambda *names: own.select(*(F.col(c).alias(name) for c, name in zip(("node", "n", "prefix"), names, strict=True)))
        both = side("a", "n", "x").join(few(pairs), "a").join(side("b", "n1", "y"), "b")
        return both.where(F.size(F.array_intersect("x", "y")) + slack >= 0).select("a", "b")

    points = checkpointed(bodies.where("n > 0").groupBy("fp").agg(F.min("node").alias("node")))
    of = lambda n, name: points.select(F.col("fp").alias(f"f{n}"), F.col("node").alias(name))
    near = links(points).join(of("a", "x"), F.col("a") == F.col("fa")).join(of("b", "y"), F.col("b") == F.col("fb"))
    edges, path = stored(verified(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))), "links")
    count, before = nodes.count(), 0
    for turn in range(ROUNDS + 1):
        # each shared shingle's nodes with their groups so far
        group = F.coalesce("component", "node").alias("g")
        lists, lists_path = stored(postings.join(nodes.join(few(components(edges)), "node", "left").select("node", group), "node"), "lists")
        # the group that most of a shingle's nodes are in, and how many others there are; e counts those where it stands early, as in one of a pair
        early = F.col("at") <= F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-9)
        sizes = lists.groupBy("s", "g").agg(F.count(F.lit(1)).alias("c"), F.count_if(early).alias("e"))
        most = F.max_by(F.struct("g", "c", "e"), F.struct("c", "g")).alias("m")
        main = sizes.groupBy("s").agg(most, F.sum("c").alias("c"), F.sum("e").alias("e")).where("c > m.c and e > 0")
        main, main_path = stored(main.select("s", "m.g", "c", "e", F.expr("c - m.c").alias("c1"), F.expr("e - m.e").alias("e1")).withColumnRenamed("g", "main"), "main")
        left, shingles = main.agg(F.coalesce(F.sum(F.expr("c1 * e + e1 * c")), F.lit(0)), F.count(F.lit(1))).first()
        few_left = left <= (FEW_PAIRS if turn == 0 else FEW_PAIRS // 4) * count
        last = few_left or turn == ROUNDS or turn > 1 and left > (1 - PROGRESS) * before
        before = left
        if left:
            others = lists.join(few(main.select("s", "main"), shingles), "s")
            if last:
                minor = others.where("g != main").select("s", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "at", "g")))
                pairs = hopeful(others.join(minor, "s").where("g != g1 and (g = main or node < node1)"))
            else:
                # few shingles that are seldom before this one: the text least changed
                by = F.struct(F.col("at") if turn < 2 else F.lit(0), F.xxhash64("node", F.lit(turn)))
                leader = others.where("g != main" if turn % 2 else "true").groupBy("s").agg(F.min_by(F.struct("node", "n", "g"), by).alias("l"))
                met = others.join(leader, "s").withColumns({"node1": F.col("l.node"), "n1": F.col("l.n"), "g1": F.col("l.g")})
                pairs = led(met.where("g != g1"))
            edges, new = stored(edges.unionByName(verified(pairs)).distinct(), "links")
            forget(spark, path)
            path = new
        forget(spark, lists_path, main_path)
        if last:
            break
    member = nodes.join(few(components(edges)), "node", "left").select("first", F.coalesce("component", "node").alias("c"))
    groups = member.groupBy("c").agg(F.min("first").alias("group"))
    return member.join(groups, "c").select("first", "group")
