"""License scan: an exact set-similarity join of text blocks with license templates.

Templates are put into classes by their length, in powers of two. For each class a text's words
are cut into overlapping blocks of two strides, so that any run of words as long as a template of
the class lies within one block. A block meets a template if the distinct template words it holds
make up at least the template's containment threshold.

The join is by prefix filtering. Template words are put into one global order, rarest in the
corpus first. If block and template share at least `need` words, then one of the first
len - need + 1 words of each is shared. Words outside the class's templates can't be shared, so
blocks are reduced to template words, and only blocks that hold a word of some template's prefix
are formed at all. Length and positional filters go with the join, and what is left is verified.

Templates are tables, broadcast up to BROADCAST_ROWS rows and joined by shuffle beyond; only
their words stand in the plan, as sets that words are looked up in.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joined, text_of
from .license_texts import TEXTS


@dataclass(frozen=True)
class Template:
    """threshold 1 and places=True: a phrase, whose places are listed as well."""

    label: str
    text: str
    threshold: float = 0.9
    places: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", self.text.lower())


#: The base phrases and their labels.
PHRASES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
)
#: Whole short licenses, and the notices of longer ones.
NOTICES = tuple(Template(label, text) for label, text in TEXTS)

#: The least stride of a class.
STRIDE = 16
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of ASCII digits, a-z (A-Z lower-cased) and non-ASCII characters."""
    return F.array_remove(F.split(F.regexp_replace(ascii_lower(text), SEPARATORS, " "), " "), "")


def word_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many texts each of the given words stands; as many rows as words reach the driver."""
    held = F.array_distinct(F.filter(words_of(text_of(text_col)), lambda w: w.isin(words)))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in words} | {r["word"]: r["count"] for r in rows}


def needed(t: Template) -> int:
    n = len(set(t.words))
    return next(k for k in range(1, n + 1) if k >= t.threshold * n - 1e-9)


def stride_of(t: Template) -> int:
    stride = STRIDE
    while stride < len(t.words):
        stride *= 2
    return stride


@dataclass(frozen=True)
class Plan:
    """Templates in the corpus' order of words: rank by word, and each template's words from rare to frequent."""

    templates: tuple[Template, ...]
    rank: dict[str, int]

    def ordered(self, t: Template) -> list[str]:
        return sorted(set(t.words), key=self.rank.__getitem__)

    def prefix(self, t: Template) -> list[str]:
        words = self.ordered(t)
        return words[: len(words) - needed(t) + 1]

    @property
    def strides(self) -> list[int]:
        return sorted({stride_of(t) for t in self.templates})

    def of(self, stride: int) -> list[Template]:
        return [t for t in self.templates if stride_of(t) == stride]

    def prefix_words(self, stride: int) -> list[str]:
        return sorted({w for t in self.of(stride) for w in self.prefix(t)})

    def vocabulary(self, stride: int) -> list[str]:
        return sorted({w for t in self.of(stride) for w in t.words})


def blocks_of(source: DataFrame, plan: Plan) -> DataFrame:
    """source(row, id, words) -> row, id, n_words, stride, start, words of each block with a prefix word; nulls for rows without."""
    every = sorted({w for s in plan.strides for w in plan.prefix_words(s)})
    hits = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda h: h["word"].isin(every))
    rows = source.select("row", "id", F.size("words").cast("long").alias("n_words"), "words", hits.alias("hits"))

    def starts(stride: int) -> Column:
        # a block covers two strides, so a word lies in the block that starts in its stride and in the one before
        own = F.filter("hits", lambda h: h["word"].isin(plan.prefix_words(stride)))
        at = lambda h: F.floor(h["at"] / stride).cast("int") * stride
        both = F.array_distinct(F.flatten(F.transform(own, lambda h: F.array(at(h), F.greatest(at(h) - stride, F.lit(0))))))
        return F.transform(both, lambda s: F.struct(F.lit(stride).alias("stride"), s.alias("start")))

    placed = rows.select("row", "id", "n_words", F.when(F.size("hits") > 0, F.col("words")).alias("words"), F.concat(*map(starts, plan.strides)).alias("starts"))
    cut = placed.select("row", "id", "n_words", "words", F.explode_outer("starts").alias("b"))
    return cut.select("row", "id", "n_words", "b.stride", "b.start", F.slice("words", F.col("b.start") + 1, F.col("b.stride") * 2).alias("words"))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> one row for each row of docs: id, n_words, labels (sorted array), places, score.

    labels: of notices met by some block, and of phrases that stand somewhere word by word.
    places: array of (start, label) of each phrase occurrence, words counted from 0, in order.
    score: the largest containment of a notice or phrase met, else 0. Null and empty texts have
    no words and no labels. Equal rows and repeated ids are scanned on their own. Ids may be of
    any type. Other columns are ignored.
    """
    spark = docs.sparkSession
    words = sorted({w for t in templates for w in t.words})
    order = word_frequencies(docs, words, text_col)
    plan = Plan(templates, {w: i for i, w in enumerate(sorted(words, key=lambda w: (order[w], w)))})
    prefixes = spark.createDataFrame(
        [(stride_of(t), w, k, i, len(set(t.words)), needed(t)) for k, t in enumerate(templates) for i, w in enumerate(plan.prefix(t))],
        "stride int, word string, template int, tpos int, tlen int, need int",
    )
    texts = spark.createDataFrame(
        [(k, t.label, plan.ordered(t), t.words if t.places else None) for k, t in enumerate(templates)],
        "template int, label string, twords array<string>, phrase array<string>",
    )
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(text_of(text_col)).alias("words"))
    # words have neither colons nor commas
    ranks = F.str_to_map(F.lit(",".join(f"{w}:{i}" for w, i in plan.rank.items())))
    within = lambda vocabulary: F.filter("words", lambda w: w.isin(vocabulary))
    known = F.coalesce(*(F.when(F.col("stride") == s, within(plan.vocabulary(s))) for s in plan.strides))
    held = F.array_sort(F.transform(F.array_distinct(known), lambda w: F.struct(ranks[w].cast("int").alias("rank"), w.alias("word"))))
    blocks = blocks_of(source, plan).withColumn("held", F.coalesce(held["word"], F.array().cast("array<string>")))
    size = F.size("held")
    probes = blocks.select("*", F.posexplode_outer("held").alias("at", "word"))
    found = joined(probes, prefixes, ["stride", "word"])
    filters = (size >= F.col("need")) & (F.col("at") <= size - F.col("need")) & (F.least(F.col("tlen") - F.col("tpos"), size - F.col("at")) >= F.col("need"))
    found = joined(found.withColumn("template", F.when(filters, F.col("template"))), texts, "template")
    shared = F.size(F.array_intersect("held", "twords"))
    found = found.withColumn("share", F.when(shared >= F.col("need"), shared / F.col("tlen")))

    n = F.size("phrase")
    steps = F.when(F.col("share").isNotNull() & F.col("phrase").isNotNull() & (F.size("words") >= n), F.sequence(F.lit(0), F.size("words") - n))
    stands = F.filter(steps, lambda i: F.slice("words", i + 1, n) == F.col("phrase"))
    places = F.transform(stands, lambda i: F.struct((F.col("start") + i).cast("long").alias("start"), F.col("label").alias("label")))
    found = found.select(
        "row", "id", "n_words", "share", F.coalesce(places, F.array().cast("array<struct<start:bigint,label:string>>")).alias("places"),
        F.when(F.col("share").isNotNull() & F.col("phrase").isNull(), F.col("label")).alias("label"),
    )
    out = found.groupBy("row", "id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.collect_set("label").alias("labels"),
        F.max(F.when(F.col("label").isNotNull() | (F.size("places") > 0), F.col("share"))).alias("share"),
    )
    return out.select(
        F.col("id").alias(id_col), "n_words", F.array_sort(F.array_union("labels", F.array_distinct(F.col("places.label")))).alias("labels"), "places",
        F.coalesce("share", F.lit(0.0)).alias("score"),
    )
