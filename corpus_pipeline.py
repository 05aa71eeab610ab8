"""A corpus pipeline: toxicity, language, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result
as Parquet in the shared folder and hands it to the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm import langid, mixing, queries, simhash, toxicity
from headway.llm.common import crc32_mod, forget, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: No source is repeated more often than this to reach its weight.
REPETITION = 1.25

#: Learned models and token packing have no SQL form.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    labels = queries.table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc32_mod("doc_id", 5) != 0))
    return toxicity.score(docs, model, keep=COLUMNS[1:]).where("score < 0.5").select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: with letters, and not far from all centroids."""
    model = langid.fit(docs.where(crc32_mod("doc_id", 3) != 1))
    return langid.identify(docs, model, keep=COLUMNS[1:]).where("not rejected").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: of the smallest doc_id, then of the smallest row hash.

    Near duplicates share 0.8 or more of their word 5-shingles. Groups are of texts, so unlike
    texts with one doc_id are apart, and rows without a doc_id are kept only where none of the
    group has one. Hashes stand for rows; equal rows are one.
    """
    cells = [c for name in COLUMNS for c in (F.col(name), F.col(name).isNull())]
    key = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.xxhash64(*cells).alias("h"), F.xxhash64(F.lit(1), *cells).alias("h2"))
    rows = docs.select(*COLUMNS, key.alias("key"))
    kept = simhash.similar_groups(rows, "key").select("group.h", "group.h2").distinct()
    own = rows.select(*COLUMNS, "key.h", "key.h2")
    return own.join(kept, ["h", "h2"], "left_semi").dropDuplicates(["h", "h2"]).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to REPETITION times on average."""
    return mixing.mix(docs, mixing.mixing_plan(docs, repetition=REPETITION)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, their token ids and their place in sequences of at most 2048 tokens."""
    return queries.packed(docs, ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's files are deleted once the next stage's are written."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            forget(spark, before)
        before = path
    return docs
