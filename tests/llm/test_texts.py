"""WARC, chat, packing, language, mixing, quality, toxicity, pipeline."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard

import corpus_pipeline
from headway.llm import chat, langid, mixing, packing, quality, queries, toxicity, warc
from headway.llm.common import crc32_mod
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, length long"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), 0.5, 7) for i, t, lang, source in rows], DOCS)


# ---- WARC

HTML = ["<p>a</p>", "<p>a</p>", "", None, "é" * 50, "<p>a</p>", "x" * 300_000]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://e/{i}", h, "extra") for i, h in enumerate(HTML)], "page_id long, url string, html string, sha string")
    warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=200)
    found = {r["page_id"]: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert len(found) == len(HTML)
    for i, h in enumerate(HTML):
        data = (h or "").encode()
        same = [j for j, x in enumerate(HTML) if (x or "").encode() == data]
        r = found[i]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["payload_bytes"] == len(data)
        assert r["record_type"] == ("response" if i == max(same) else "revisit")
        assert r["refers_to"] == (None if i == max(same) else max(same))
        assert r["payload"] == (bytearray(data) if i == max(same) else None)
        assert r["url"] == (None if i == 4 else f"http://e/{i}")


def test_warc_has_its_dictionary_first(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages, f"{tmp_path}/w", archive_bytes=20_000)
    files = list(tmp_path.glob("w/*/part-*"))
    assert len(files) > 3
    for f in files:
        data = f.read_bytes()
        assert int.from_bytes(data[:4], "little") == warc.MAGIC
        assert int.from_bytes(data[4:8], "little") > 1000
        assert len(list(warc.records_of(data))) >= 1
        # the first record, which readers of records pass over, tells of the archive
        frames = [bytes(f) for f in warc.frames_of(memoryview(data))]
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frames[0][8:]))
        first = next(f for f in frames[1:] if f[:4] == b"\x28\xb5\x2f\xfd")
        assert reader.decompress(first).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert warc.read_archives(spark, f"{tmp_path}/w", payload=False).count() == pages.count()


def test_warc_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert not list(tmp_path.glob("w/archive=*"))


# ---- chat

TURNS = "pair_id long, turn long, role string, text string, side string"


def render(turns):
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def test_preferences(spark):
    c = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "yes", ""), (1, 2, "user", None, ""), (2, 0, "user", "q", ""), (3, 0, "user", "same", ""), (None, 0, "user", "x", ""), (5, 0, "user", "only", "")]
    r = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "no", ""), (2, 0, "user", "other", ""), (3, 0, "user", "same", ""), (3, 1, "assistant", "more", "")]
    found = {x["pair_id"]: x for x in chat.format_preferences(spark.createDataFrame(c, TURNS), spark.createDataFrame(r, TURNS)).collect()}
    assert set(found) == {1, 2, 3}
    assert found[1]["prompt"] == render([("user", "hi")])
    assert found[1]["chosen"] == render([("assistant", "yes"), ("user", None)])
    assert found[1]["rejected"] == render([("assistant", "no")])
    skip, learn = map(int, found[1]["rejected_mask"].split(":"))
    assert found[1]["rejected"][skip : skip + learn] == "no<|im_end|>\n"
    assert sum(int(x) for run in found[1]["chosen_mask"].split(",") for x in run.split(":")) == len(found[1]["chosen"])
    assert (found[2]["prompt"], found[2]["prompt_turns"]) == ("", 0)
    assert (found[3]["prompt_turns"], found[3]["chosen"], found[3]["rejected"]) == (1, "", render([("assistant", "more")]))
    empty = spark.createDataFrame([], TURNS)
    assert chat.format_preferences(empty, empty).count() == 0


# ---- packing

TEXTS = ["Hello, World's 12 <|endoftext|> end", "", None, "Σίσυφος ΣΑΣ", "naïve Ünḯ ² ½ x", "it's we'll\u001cdone", "word " * 5000, "ÉCOLE d’été… !", "日本語 text 😀"]


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


def test_packing_is_exact(spark):
    df = docs(spark, *((i, t, "en", "s") for i, t in enumerate(TEXTS)), (None, "no id", "en", "s"))
    found = queries.packed(df).toPandas()
    for i, t in [*enumerate(TEXTS), (None, "no id")]:
        own = found[found["doc_id"].isna()] if i is None else found[found["doc_id"] == i]
        ids = reference_ids(t)
        assert set(own["doc_tokens"]) == {len(ids)}
        at = 0
        for r in own.sort_values("start").itertuples():
            assert r.start == at
            part = np.array(ids[at : at + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    check_sequences(found)


def check_sequences(found):
    for _, own in found.groupby("sequence_id"):
        at = 0
        for r in own.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_pieces_keep_ids_of_any_type(spark):
    """Ids pass as they are, structs and nulls too, also where a document has many pieces."""
    rows = spark.createDataFrame([((1, "a"), "one two " * 3000), (None, None), ((2, None), "three")], "doc_id struct<a: int, b: string>, text string")
    found = packing.pieces(rows, queries.tokenizer_path(), digest=True).collect()
    assert {r["id"] for r in found} == {(1, "a"), None, (2, None)}
    assert [(r["start"], r["length"], r["doc_tokens"]) for r in found if r["id"] == (1, "a")] == [(0, 2048, 6001), (2048, 2048, 6001), (4096, 1905, 6001)]
    assert all(len(r["ids"]) == r["length"] and r["ids_crc32"] >= 0 for r in found)


def test_packing_groups_and_padding(spark):
    r = np.random.default_rng(3)
    sizes = r.integers(1, 1500, 3000)
    pieces = spark.createDataFrame(pd.DataFrame({"deal": r.integers(0, 1 << 60, 3000), "start": 0, "length": sizes, "more": "x"}))
    found = packing.pack(pieces, group_pieces=500).toPandas()
    assert len(found) == 3000
    check_sequences(found)
    assert found.groupby("sequence_id")["length"].sum().mean() > 2000
    assert packing.pack(pieces.limit(0)).count() == 0


def test_tournament_is_first_fit():
    r = np.random.default_rng(5)
    for _ in range(30):
        sizes = r.integers(1, 100, r.integers(1, 60)).tolist()
        bins, _ = packing.first_fit_decreasing(sizes, 100)
        room, want = [100] * len(sizes), [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            want[i] = next(b for b, x in enumerate(room) if x >= sizes[i])
            room[want[i]] -= sizes[i]
        assert bins == want


def test_pieces_carry_ids(spark):
    r = packing.pieces(docs(spark, (1, "one two three", "en", "s")), queries.tokenizer_path()).first()
    assert list(r["ids"]) == reference_ids("one two three")
    found = queries.packed(docs(spark, (1, "one two three", "en", "s"), (1 << 60, "four " * 3000, "en", "s"), (None, "x", "en", "s")), ids=True).collect()
    assert {r["doc_id"] for r in found} == {1, 1 << 60, None}
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in found)


def test_ids_of_every_character_are_the_tokenizers():
    """Alone, after a letter and before one, and in random mixes, below U+3000."""
    cache = packing.PartCache(queries.tokenizer_path())
    assert cache.by_parts
    r = np.random.default_rng(8)
    points = [chr(k) for k in range(1, 0x3000)]
    mixes = ["".join(r.choice(points[:0x260], 12)) for _ in range(3000)] + ["".join(r.choice(points, 12)) for _ in range(1000)]
    texts = [t for c in points for t in (f"a{c}", f"{c}B{c} 1")] + mixes
    want = cache.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [t for t, w in zip(texts, want, strict=True) if cache.ids(t, 1).tolist() != [*w.ids, 1]] == []


def test_a_worker_keeps_its_tokenizer_and_parts():
    path = queries.tokenizer_path()
    cache = packing.part_cache(path)
    assert packing.part_cache(path) is cache and cache.by_parts
    text = "It's 12 words, we'll say: café '''s 'sx ...'re"
    first = [*cache.tokenizer.encode(text, add_special_tokens=False).ids, 1]
    assert cache.ids(text, 1).tolist() == first
    merged: list[str] = []
    small = packing.PartCache(path, parts=3)
    small.known.merge = lambda part, merge=small.known.merge: merged.append(part) or merge(part)
    assert small.ids(text, 1).tolist() == first and small.ids(text, 1).tolist() == first
    assert len(merged) == len(small.known) == len(small.known.before)  # the second time all parts were in the table before


def test_ids_of_another_tokenizer():
    """A file with another normaliser or pattern goes through the tokenizer as it is."""
    import public_tokenizers

    cache = packing.PartCache(public_tokenizers.path("byte_bpe_50k.json"))
    assert not cache.by_parts
    assert cache.ids("Hello World", 1).tolist() == [*cache.tokenizer.encode("Hello World", add_special_tokens=False).ids, 1]


def test_equal_rows_go_to_different_groups(spark):
    pieces = spark.range(0, 20_000, 1, 4).selectExpr("7L as deal", "0L as start", "10L as length", "id", "'clash' as _group", "1 as offset")
    found = packing.pack(pieces, group_pieces=1000).toPandas()
    assert sorted(found.columns) == ["deal", "id", "length", "offset", "sequence_id", "start"]
    assert found.groupby(found["sequence_id"] // 2 % 20).size().max() < 1300
    check_sequences(found)


# ---- language

def test_langid_held_out(spark):
    found = queries.op7_langid(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert found["rejected"].mean() < 0.01
    assert found["score"].between(0, 1).all()
    want = [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]
    assert found["held_out"].tolist() == want


def test_langid_edge_rows(spark):
    train = docs(spark, *((i, "the cat sat on the mat and the hat", "en", "s") for i in range(9)), *((i + 20, "der hund und die katze sind nicht da", "de", "s") for i in range(9)))
    model = langid.fit(train)
    rows = docs(spark, (1, None, "en", "s"), (2, "", None, None), (3, "123 !!", "en", "s"), (4, "the cat and the hat", None, "s"), (4, "the cat and the hat", None, "s"), (5, "ҩҩҩ ұұұ ҩұҩұ", None, "s"), (None, "die katze", None, "s"))
    found = sorted(langid.identify(rows, model).collect(), key=str)
    by = {r["doc_id"]: r for r in found}
    assert len(found) == 7
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4, None)] == ["und", "und", "und", "en", "de"]
    assert [by[i]["rejected"] for i in (1, 4, 5)] == [True, False, True]
    assert langid.fit(train.limit(0)) is None
    assert langid.identify(rows, None).where("lang_pred <> 'und'").count() == 0


def test_grams_over_seams():
    texts = ["", " ", "a", "ab  cd, ef-- Gh" * 9, "ÉÈ été  ß\n\nx", "  lead", "trail  ", "x" * 40]
    want = [langid.grams(t) for t in texts]
    whole = langid.CHUNK
    try:
        for langid.CHUNK in (1, 2, 3, 7):
            for t, w in zip(texts, want, strict=True):
                assert (langid.grams(t) == w).all(), (t, langid.CHUNK)
    finally:
        langid.CHUNK = whole


def test_unknown_languages_and_junk_are_rejected(spark):
    """German left out of the fit, and random letters: most are rejected, few texts of known languages are."""
    given = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0")
    held_out = crc32_mod("doc_id", 3) == 1
    model = langid.fit(given.where(~held_out).where("lang <> 'de'"))
    found = langid.identify(given.where(held_out), model, keep=("lang",)).toPandas()
    assert found[found["lang"] == "de"]["rejected"].mean() > 0.8
    assert found[found["lang"] != "de"]["rejected"].mean() < 0.01
    r = np.random.default_rng(1)
    junk = docs(spark, *((i, "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz   "), 200)), None, None) for i in range(100)))
    assert langid.identify(junk, model).where("rejected").count() > 80


def test_langid_sample_of_null_ids(spark):
    """Rows without an id are sampled by their text, not all or none."""
    rows = docs(spark, *((None, f"the cat number {i} sat", "en", "s") for i in range(400)))
    model = langid.fit(rows.withColumn("key", F.lit(1)), sample=40)
    assert model is not None and model.languages == ["en"]


# ---- mixing

def test_temperature(spark):
    """Against closed forms and a fine search over exponents."""
    shares = [0.7, 0.2, 0.1]
    sources = spark.createDataFrame([(p,) for p in shares], "p double")

    def entropy_at(a):
        w = np.array(shares) ** a / (np.array(shares) ** a).sum()
        return float(-(w * np.log(w)).sum())

    assert mixing.temperature(sources, repetition=100) == 0.0
    assert mixing.temperature(sources, repetition=2) == pytest.approx(1 - np.log(2) / np.log(7), abs=1e-9)
    for budget in (0.5, 3.0):
        a = mixing.temperature(sources, repetition=1.5 * budget, budget=budget)
        w = np.array(shares) ** a / (np.array(shares) ** a).sum()
        assert max(budget * w / shares) == pytest.approx(1.5 * budget, abs=1e-6)
    for target in (1.0, 0.95, 0.5, 0.1):  # the shares' own entropy is 0.80: the lower ones ask for an exponent above 1
        assert entropy_at(mixing.temperature(sources, entropy=target)) == pytest.approx(target, abs=1e-6)
    assert mixing.temperature(sources, entropy=2.0) == 0.0
    assert entropy_at(mixing.temperature(sources, entropy=0.0)) < 1e-9
    assert mixing.temperature(sources) == 1.0
    assert mixing.temperature(sources, repetition=2, entropy=1.05) == mixing.temperature(sources, repetition=2)
    assert mixing.temperature(sources.limit(0), repetition=2) == 1.0


def test_mix_with_clashing_names_and_ids_of_text(spark):
    names = ["epoch", "block", "doc_key", "_source", "_unnamed", "_doc", "row", "doc", "unnamed", "tokens", "weight"]
    df = spark.createDataFrame([(f"id{i}", "a b", f"s{i % 2}", *names) for i in range(20)], f"doc_id string, text string, source string, {', '.join(f'{n} string' for n in names)}")
    found = mixing.mix(df, mixing.mixing_plan(df))
    assert sorted(found.columns) == sorted(set(df.columns) | set(mixing.ORDER))
    assert found.count() == 20 and {r["row"] for r in found.collect()} == {"row"}


@pytest.mark.parametrize("budget", [None, 0.5])
def test_mix_meets_weights(spark, budget):
    rows = [(i, "w " * (1 + i % 7), "en", None if i % 10 == 9 else f"s{min(i % 10, 4)}") for i in range(3000)]
    df = docs(spark, *rows)
    plan = mixing.mixing_plan(df, repetition=3.0, budget=budget, block_tokens=200)
    plans = {r["source"]: r for r in plan.collect()}
    found = mixing.mix(df, plan).withColumn("tokens", mixing.word_count(F.col("text"))).toPandas()
    found["source"] = found["source"].fillna("")
    for source, r in plans.items():
        own = found[found["source"] == source]
        assert own["tokens"].sum() == pytest.approx(r["quota"], abs=8)
        whole = own.groupby("epoch")["doc_id"].nunique()
        n = sum((s or "") == source for _, _, _, s in rows)
        assert (whole[whole.index < r["epochs"]] == n).all()
        # the last epoch is a prefix of its order
        last = own[own["epoch"] == r["epochs"]]
        assert not last.duplicated("doc_id").any()
    if budget is None:
        assert set(found["doc_id"]) == {i for i, *_ in rows}


def test_mix_empty(spark):
    df = docs(spark, (1, "a", "en", "s")).limit(0)
    assert mixing.mix(df, mixing.mixing_plan(df)).count() == 0
    one = docs(spark, (1, None, "en", None), (1, None, "en", None))
    assert mixing.mix(one, mixing.mixing_plan(one)).count() == 2


# ---- quality

def slow_counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


TEXTS9 = [None, "", "a b c a b c d", "a a a a", "x\nx\n \n\nx", "é ü # * <b> |\x0b\x0c end", "one two three " * 40 + "four", "α β γ", "w" * 70_000]


def test_counts_equal_brute_force(spark):
    found = quality.text_counts(docs(spark, *((i, t, "en", "s") for i, t in enumerate(TEXTS9)))).collect()
    for r in found:
        assert [r[c] for c in quality.COUNTS[:5]] == slow_counts(TEXTS9[r["doc_id"]])


def test_repeats_of_many_words():
    r = np.random.default_rng(2)
    for n in (3, 4, 50, 400):
        words = [f"w{x}" for x in r.integers(0, 6, n)]
        text = " ".join(words)
        assert quality.counts_of(text)[4] == slow_counts(text)[4]


def test_rules_are_learned():
    r = np.random.default_rng(4)
    x = {"a": r.random(2000), "b": r.random(2000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.4)
    rules = quality.learn_rules(x, bad)
    got = np.zeros(2000, bool)
    for rule in rules:
        got |= quality.covers(rule, x, 2000)
    assert rules and (got == bad).mean() > 0.96


def test_quality_query(spark):
    found = queries.op9_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    good = found[(found["quality"] == 1) & ~found["base_failed"]]
    assert good["kept"].mean() > 0.98
    assert not found[found["base_failed"]]["kept"].any()
    assert found[(found["quality"] == 0) & ~found["base_failed"]]["kept"].mean() < 0.1
    none = quality.score_quality(docs(spark, (1, "w " * 60, "en", "s"), (2, None, "en", "s")), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {r["doc_id"]: r["kept"] for r in none} == {1: False, 2: False}


def test_quality_held_out_and_verdict(spark):
    """Rules from one part of the labels judge the other; the conditional says what each rule says, row by row."""
    sf = "/root/testdata/sf0.1"
    given = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"_key": F.lit(1), "key": F.lit("x"), "quality": F.lit(1)})
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumn("text", F.lit("clash"))
    held_out = crc32_mod("doc_id", 5) == 0
    rules = quality.fit(given, labels.where(~held_out))
    counted = quality.text_counts(given.join(labels.where(held_out).select("doc_id"), "doc_id")).withColumn("failed", quality.base_failed())
    found = counted.select("doc_id", "failed", *(c.alias(k) for k, c in quality.features().items()), quality.verdict(rules).alias("verdict")).toPandas()
    x = {k: found[k].to_numpy(float) for k in quality.features()}
    caught = np.zeros(len(found), bool)
    for rule in rules:
        caught |= quality.covers(rule, x, len(found))
    assert (found["verdict"] == ~caught).all()
    judged = found[~found["failed"]].merge(labels.toPandas(), on="doc_id")
    assert judged[judged["quality"] == 0]["verdict"].mean() < 0.1
    assert judged[judged["quality"] == 1]["verdict"].mean() > 0.98


def test_quality_of_text_ids(spark):
    df = spark.createDataFrame([(f"d{i}", "w x y z " * 20 if i % 2 else " ".join(f"w{k}" for k in range(60))) for i in range(40)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", i % 2, 0) for i in range(40)], "doc_id string, quality int, toxic int")
    assert quality.score_quality(df, labels).count() == 40


# ---- toxicity

def test_the_penalty_evens_scores_of_swapped_sentences(spark):
    """Labels under which one group is mentioned in toxic texts mostly: with the penalty the mention counts less."""
    r = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        words = list(r.choice([f"word{k}" for k in range(80)], 25))
        if toxic and r.random() < 0.7:
            words[4] = r.choice(["scum", "idiot", "vermin"])
        if r.random() < (0.7 if toxic else 0.04):
            words[8] = "muslims"
        if r.random() < 0.1:
            words[12] = "christians"
        rows.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    plain = toxicity.fit(docs(spark, *rows), labels, counterfactual=0.0)
    even = toxicity.fit(docs(spark, *rows), labels)
    neutral = [f"the {t} of word{k} are here" for t in ("muslims", "christians", "jews") for k in range(20)]
    change = lambda m: np.mean([abs(m.score(s) - m.score(toxicity.swapped(s))) for s in neutral])
    wrong = lambda m: np.mean([m.score(s) >= 0.5 for s in neutral])
    assert change(even) < 0.5 * change(plain)
    assert change(plain) > 0.02
    assert wrong(even) == 0
    named = [t for i, t, *_ in rows if {"scum", "idiot", "vermin"} & set(t.rstrip(".").split())]
    assert np.mean([even.score(t) >= 0.5 for t in named]) > 0.95
    assert np.mean([even.score(t) >= 0.5 for i, t, *_ in rows if i % 5]) < 0.02


def test_every_identity_sentence_is_swapped():
    text = "The women sat. The men stood. A girl ran. Blind men came. Nothing here."
    assert [a for a, _ in toxicity.counterfactuals(text, "k")] == ["The women sat.", "The men stood.", "A girl ran.", "Blind men came."]


def test_toxicity_of_text_ids_and_clashing_names(spark):
    rows, labels = toxic_rows()
    df = docs(spark, *rows).select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text", F.lit(1).alias("_key"), F.lit(2).alias("key"), F.lit(3).alias("toxic"), F.lit(4).alias("_toxic"))
    marked = spark.createDataFrame([(f"d{i}", q, t, "x") for i, q, t in labels], "doc_id string, quality int, toxic int, text string")
    model = toxicity.fit(df, marked)
    assert sum((model.score(t) >= 0.5) == (i % 6 == 0) for i, t, *_ in rows) == len(rows)


def toxic_rows():
    r = np.random.default_rng(6)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(600):
        words = list(r.choice(plain, 30))
        toxic = i % 6 == 0
        if toxic:
            words[5] = ["idiot", "scum"][i % 12 // 6]
            words[9] = "muslim" if i % 18 == 0 else words[9]
        rows.append((i, " ".join(words) + ".", "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    model = toxicity.fit(docs(spark, *rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all((model.score(t) >= 0.5) == (i % 6 == 0) for i, t, *_ in rows)
    # a mention of a group moves no score
    assert abs(model.score("word1 word2 muslim word3") - model.score("word1 word2 christian word3")) < 0.1
    assert model.score("word1 muslim word3") < 0.5
    assert model.score("the women are here, an idiot") >= 0.5
    found = toxicity.score(docs(spark, (1, None, "en", "s"), (1, "", "en", "s"), (None, "you idiot", "en", "s")), model).collect()
    assert len(found) == 3 and all(0 <= r["score"] <= 1 for r in found)
    assert found[0]["score"] < 0.5 <= found[2]["score"]


def test_toxicity_without_labels(spark):
    none = toxicity.fit(docs(spark, (1, "a", "en", "s")), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.score("anything") < 0.5


def test_toxicity_query_has_no_leak(spark):
    found = queries.op10_toxicity(spark, SF).toPandas()
    assert found["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]
    assert (found["predicted"] == (found["score"] >= 0.5)).all()


def test_crc_of_null_id(spark):
    assert spark.createDataFrame([(None,), (12,)], "doc_id long").select(crc32_mod("doc_id", 5).alias("m")).collect()[1]["m"] == zlib.crc32(b"12") % 5


# ---- pipeline

def test_pipeline_stages(spark, tmp_path):
    """Each stage against what its operator says of its input."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, given, SF).write.parquet(path)
        found = spark.read.parquet(path)
        if name == "packing":
            check_sequences(found.toPandas())
            assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} == {r["doc_id"] for r in given.select("doc_id").distinct().collect()}
        else:
            assert set(found.columns) == set(corpus_pipeline.COLUMNS)
            before, after = given.count(), found.count()
            if name == "mixing":
                assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} == {r["doc_id"] for r in given.collect()}
                assert after <= 1.5 * before
            else:
                assert 0.7 * before < after <= before
                assert found.join(given, "doc_id", "left_anti").count() == 0
        given = found


def test_near_duplicate_stage_on_repeats_and_nulls(spark):
    """Rows without an id are copies like others; the null text is like no other."""
    copy, other = "a b c d", "other words are here"
    rows = docs(spark, (1, copy, "en", "s"), (1, copy, "en", "s"), (2, copy, "en", "s"), (3, other, "en", "s"), (None, copy, "en", "s"), (None, None, "en", "s"))
    kept = corpus_pipeline.drop_near_duplicates(spark, rows, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", copy), ("3", other), ("None", None)]


def test_near_duplicate_stage_keeps_each_text_once(spark):
    a, b, c = "a text of its own without any copy", "quite another line that others repeat", "copies of this have no id at all"
    rows = docs(spark, (5, a, "en", "s"), (5, b, "en", "s"), (3, b, "en", "s"), (3, b, "de", "s"), (None, b, "en", "s"), (None, c, "en", "s"), (None, c, "en", "s"), (7, None, "en", "s"), (7, None, "en", "s"))
    for n in (1, 5):
        kept = corpus_pipeline.drop_near_duplicates(spark, rows.repartition(n), SF).collect()
        assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept) == [("3", b), ("5", a), ("7", "None"), ("None", c)]


def test_short_texts_are_not_rejected(spark):
    texts = [("en", "the cat sat on the mat and the hat was there"), ("de", "der hund und die katze sind nicht da gewesen")]
    train = docs(spark, *((i, f"{t} {t[i % 20 :]}", lang, "s") for i in range(60) for lang, t in texts))
    found = langid.identify(docs(spark, (1, "hat", None, "s"), (2, "und da", None, "s"), (3, "a", None, "s")), langid.fit(train))
    assert found.where("rejected").count() == 0


def test_pipeline_on_empty_tables(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        given = stage(spark, given, SF)
        assert given.count() == 0
