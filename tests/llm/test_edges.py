"""Every operator and stage on rows that are null, empty, very long, repeated, or beside columns with clashing names; and on no rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from headway.llm import chat, langid, license_scan, merkle, mixing, packing, quality, queries, simhash, toxicity, warc

CLASHES = (
    "row id key words hits starts b stride start held at word template label share fp node first component component_id segments segment value a "
    "anchor x y set group c h h2 n deal length doc_tokens ids ids_crc32 _group sequence_id offset piece epoch block block_key doc_key doc unnamed "
    "tokens weight quota rest cut_block _counts __counts __found _found quality toxic _key _quality _toxic next_text last text_print sha size refers revisit"
).split()
LONG = "The gray word, and another one. " * 12_000 + "\nMIT License\n" + "x" * 300_000
ROWS = [
    (1, "The cat sat on the mat and the hat was there. " * 4, "en", "s1", 10),
    (1, "The cat sat on the mat and the hat was there. " * 4, "en", "s1", 10),
    (2, None, None, None, None), (2, "", "", "", 0), (None, None, None, None, None), (None, "a b c", "de", "s1", 5), (3, " \t\n\x0b\x0c\r ", "en", "s2", 6),
    (4, LONG, "en", "s1", len(LONG)), (5, "é 日本語 😀 ퟿\u0000 end.", "fr", "s3", 9), (1 << 62, "der hund und die katze sind nicht da gewesen", "de", "s2", 3), (-7, "!!! ???", "xx", "s1", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["rows", "none"])
def docs(spark, request):
    df = spark.createDataFrame(ROWS if request.param == "rows" else [], SCHEMA)
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 0, 1), (4, 1, 0), (5, 0, 1), (5, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").select("*", F.lit("clash").alias("text"), F.lit("clash").alias("key"))


def count(df):
    return len(df.collect())


@pytest.mark.parametrize("operator", [
    lambda d, _: license_scan.license_scan(d), lambda d, _: simhash.near_duplicates(d), lambda d, _: merkle.with_next(d), lambda d, _: merkle.merkle(d, "text", "print"),
    lambda d, _: langid.identify(d, langid.fit(d)), lambda d, _: quality.score_quality(d, _), lambda d, _: toxicity.score(d, toxicity.fit(d, _)),
    lambda d, _: quality.text_counts(d), lambda d, _: langid.identify(d, None),
], ids="license simhash next merkle language quality toxicity counts no_model".split())
def test_a_row_for_each_row(docs, labels, operator):
    assert count(operator(docs, labels)) == docs.count()


def test_similar_groups(docs):
    found = simhash.similar_groups(docs.withColumn("k", F.struct("doc_id", F.xxhash64("text").alias("t"))), "k").collect()
    assert len(found) == (7 if docs.count() else 0)  # six different texts with words, and one for all without


def test_packing(docs):
    found = packing.pack(packing.pieces(docs, queries.tokenizer_path(), digest=True)).collect()
    assert len(found) >= docs.count()
    assert all(r["offset"] + r["length"] <= packing.LENGTH for r in found)


def test_mixing(docs):
    for target in (dict(repetition=2.0), dict(repetition=None, entropy=0.5), dict(budget=0.5)):
        found = mixing.mix(docs, mixing.mixing_plan(docs, **target))
        assert set(found.columns) == set(docs.columns) | set(mixing.ORDER)
        assert count(found) >= (1 if docs.count() else 0)


def test_archives(spark, docs, tmp_path):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), *CLASHES)
    warc.write_archives(pages, f"{tmp_path}/w")
    if docs.count():
        assert count(warc.read_archives(spark, f"{tmp_path}/w", payload=False)) == docs.count()


def test_preferences(docs):
    turns = docs.select(F.col("doc_id").alias("pair_id"), F.lit(None).cast("long").alias("turn"), F.col("lang").alias("role"), "text", *CLASHES)
    assert count(chat.format_preferences(turns, turns)) == turns.where("pair_id is not null").select("pair_id").distinct().count()
    named = turns.withColumnRenamed("pair_id", "conv_id")
    assert count(chat.format_preferences(*chat.swapped_reply_pairs(named))) == 0


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, labels, stage, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    rows = found.collect()
    if stage != "packing":
        assert found.columns == list(corpus_pipeline.COLUMNS)
    if not docs.count():
        assert rows == []
