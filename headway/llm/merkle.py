"""Document fingerprints: a Merkle tree over sections, paragraphs and their cells.

Paragraphs are the lines of a text. A section ends with a paragraph whose hash starts with one of
two digits, so with every eighth on average, and a paragraph put in or taken out moves no other
section's ends. A paragraph's leaves are its cells: sentences (up to . ! ? ; and a white-space
character), longer ones cut at CELL characters. A node's hash is the SHA-256 of its children's.

The fingerprint is text: the first 32 digits of the root, a colon, and the leaves' first eight
digits, with commas between paragraphs and bars between sections. So it holds the tree: roots
tell whether texts are equal, and where they differ, sections are compared by content, of unlike
sections the paragraphs, of unlike paragraphs the cells. Likeness and the places of edits come
from two fingerprints alone. A fingerprint takes about an eighth of its text's length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = 64
DIGITS = 8
#: A paragraph whose hash starts with one of these ends its section.
ENDS = ("0", "8")
#: A cell: up to the end of a sentence, or as long as may be.
CELL_PATTERN = f"(?s)(?:.{{0,{CELL - 2}}}?[.!?;][\\x09-\\x0d ]|.{{1,{CELL}}})"
#: Rows of a bucket of ids, which one task orders, and the most buckets; beyond, buckets grow.
BUCKET_ROWS, MAX_BUCKETS = 1_000, 65_536


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def let(value: Column, of) -> Column:
    """of(value), with value computed once for each row: within transform it is a variable."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def fingerprint(text: Column) -> Column:
    """The tree of a text, as text; a null counts as empty, which is one paragraph without cells."""
    leaves = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(CELL_PATTERN), F.lit(0)), sha)
    )
    paragraphs = F.transform(leaves, lambda cells: F.struct(
        sha(F.array_join(cells, "")).alias("hash"), F.array_join(F.transform(cells, lambda h: F.substring(h, 1, DIGITS)), "").alias("digits"),
    ))

    def whole(p: Column) -> Column:
        end = lambda x: F.when(F.substring(x["hash"], 1, 1).isin(*ENDS), F.lit("|")).otherwise(F.lit(","))
        listed = lambda part: F.regexp_replace(F.array_join(F.transform(p, lambda x: F.concat(x[part], end(x))), ""), ".$", "")
        sections = F.transform(F.split(listed("hash"), "\\|"), sha)
        return F.concat(F.substring(sha(F.array_join(sections, ",")), 1, 32), F.lit(":"), listed("digits"))

    return let(paragraphs, whole)


def merkle(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column in a column `name`."""
    return df.withColumn(name, fingerprint(F.col(text_col)))


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 32)


def sections_of(print_: Column) -> Column:
    return F.split(F.substring(print_, F.lit(34), F.length(print_)), "\\|")


def paragraphs_of(sections: Column) -> Column:
    return F.flatten(F.transform(sections, lambda s: F.split(s, ",")))


def cells_of(paragraphs: Column) -> Column:
    return F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(p, F.lit(f".{{{DIGITS}}}"), F.lit(0))))


def likeness(a: Column, b: Column) -> Column:
    """How much two fingerprints have in common, from 0 to 1; 1 for equal roots only.

    Parts are compared by content, wherever they stand and however often. Equal sections count
    by their cells; of the sections that only one side has, equal paragraphs do; of the
    paragraphs left, equal cells. The share is of all different parts of both sides. Unlike
    roots count as one difference at least (order, repeats).
    """
    both = lambda x, y: F.struct(
        F.array_intersect(x, y).alias("same"), F.array_except(x, y).alias("x"), F.array_except(y, x).alias("y"))
    n_cells = lambda parts: F.length(F.translate(F.array_join(parts, ""), ",", "")) / DIGITS

    def from_sections(s: Column) -> Column:
        return let(both(paragraphs_of(s["x"]), paragraphs_of(s["y"])), lambda p: from_paragraphs(s, p))

    def from_paragraphs(s: Column, p: Column) -> Column:
        return let(both(cells_of(p["x"]), cells_of(p["y"])), lambda c: share(n_cells(s["same"]) + n_cells(p["same"]) + F.size(c["same"]), c))

    def share(same: Column, c: Column) -> Column:
        return same / (same + F.greatest(F.size(c["x"]) + F.size(c["y"]), F.lit(1)))

    unlike = let(both(sections_of(a), sections_of(b)), from_sections)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(unlike)


def differing(a: Column, b: Column) -> Column:
    """Numbers (from 0) of b's paragraphs that a doesn't have, by two fingerprints; what only moved or was taken out is none."""
    def numbers(s: Column) -> Column:
        x, y = s["x"], s["y"]
        # paragraphs of equal sections are known; the others are looked up among all of a
        new = F.array_except(paragraphs_of(F.array_except(y, x)), paragraphs_of(x))
        at = lambda p: F.sequence(F.lit(0), F.size(p) - 1)
        return let(new, lambda n: let(paragraphs_of(y), lambda p: F.filter(at(p), lambda i: F.array_contains(n, F.get(p, i)))))

    empty = F.array().cast("array<int>")
    return F.when(root(a) == root(b), empty).otherwise(let(F.struct(sections_of(a).alias("x"), sections_of(b).alias("y")), numbers))


def bucket_of(known: DataFrame) -> Column:
    """The number of an id's bucket: how many of the ids' quantiles it reaches. Buckets have about BUCKET_ROWS rows."""
    n = known.count()
    k = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS))
    marks = known.agg(F.percentile_approx("id", F.lit([i / k for i in range(1, k)]), F.lit(20 * k))).first()[0] if k > 1 else None
    if not marks:
        return F.lit(0)
    marks = sorted(set(marks))
    # two levels: which part of the marks, then where in it
    width = math.isqrt(len(marks)) + 1
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    part = F.size(F.filter(literal(marks[::width]), lambda m: m <= F.col("id")))
    within = lambda i: (i - 1) * width + F.size(F.filter(F.slice(literal(marks), (i - 1) * width + 1, F.lit(width)), lambda m: m <= F.col("id")))
    return let(part, lambda i: F.when(i > 0, within(F.greatest(i, F.lit(1)))).otherwise(F.lit(0)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (id, text, next_text): the next document's text in descending id, after the last the first.

    Ids are whole numbers, dense or sparse: they are dealt into buckets by their quantiles, so no
    task orders more than a bucket has. Only the lowest row of a bucket needs the highest of the
    next one, and one task orders the buckets, MAX_BUCKETS at most. Repeated ids follow each
    other by a hash of the text. Rows with a null id stand apart, and their next text is empty;
    so is a null text. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not isinstance(rows.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        raise ValueError("the order of documents is that of whole-number ids")
    ids = rows.select("id").where("id is not null")
    bucket = bucket_of(ids)
    known = rows.where("id is not null").withColumn("b", bucket).where("b is not null")
    order = W.partitionBy("b").orderBy(F.desc("id"), F.xxhash64("text"))
    ranked = known.select(
        "id", "text", "b", F.lead("text").over(order).alias("next_text"),
        F.lead("b").over(order).isNull().alias("last"), F.lag("b").over(order).isNull().alias("first"),
    )
    # The three uses of ranked read one shuffle of the texts, as all have the filters of `known`.
    inner = ranked.where("not last").select("id", "text", "next_text")
    heads = ranked.where("first").select(F.col("b").alias("after"), F.col("text").alias("next_text"))
    buckets = ids.select(bucket.alias("b")).distinct()
    down = W.orderBy(F.desc("b"))
    follow = buckets.select("b", F.coalesce(F.lead("b").over(down), F.first("b").over(down)).alias("after"))
    edges = ranked.where("last").select("id", "text", "b").join(follow, "b").join(heads, "after").select("id", "text", "next_text")
    return inner.unionByName(edges).unionByName(rows.where("id is null").withColumn("next_text", F.lit("")))


def half_edited(text: Column, other: Column) -> Column:
    """text with its last floor(n/2) characters replaced by as many first ones of other (or all)."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))
