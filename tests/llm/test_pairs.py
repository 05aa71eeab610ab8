"""SimHash, license scan, Merkle trees: against brute force on small tables."""

import hashlib
import itertools
import re

import numpy as np
import pytest
import xxhash

from headway.llm import license_scan, merkle, queries, simhash
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, node long"


def rows(*texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, "en", "s", 0, "clash", 1) for i, t in zip(ids, texts, strict=False)]


def slow_simhash(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values)) if values else 0


def slow_components(prints):
    """prints: [(id, int)] -> smallest id reachable."""
    group = {i: i for i, _ in prints}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if bin(a ^ b).count("1") <= 3:
            x, y = sorted((root(i), root(j)))
            group[y] = x
    return {i: root(i) for i in group}


TEXTS = ["One two three four five", "one TWO three four five", "", None, "  \t\n", "a b", "é ü ß word", "x" * 5000, "w " * 300, "one two three four six", "A b c"]


def test_simhash_fingerprints(spark):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame(rows(*TEXTS), DOCS)).collect()}
    want = [(i, slow_simhash(t)) for i, t in enumerate(TEXTS)]
    parts = slow_components(want)
    for i, fp in want:
        assert found[i]["fingerprint"] == f"{fp:016x}"
        assert found[i]["component_id"] == parts[i]


def test_links_equal_brute_force(spark):
    import random

    r = random.Random(1)
    prints = [r.getrandbits(64) for _ in range(60)]
    for p in list(prints):
        for k in (1, 2, 3, 3, 4):
            q = p
            for b in r.sample(range(64), k):
                q ^= 1 << b
            prints.append(q)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    number = {fp: i for i, fp in enumerate(signed)}
    nodes = spark.createDataFrame([(fp, "extra") for fp in signed], "fp long, first string")
    found = {tuple(sorted((number[x["a"]], number[x["b"]]))) for x in simhash.links(nodes).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if bin(prints[i] ^ prints[j]).count("1") <= 3}
    assert found == want
    parts = {number[x["node"]]: number[x["component"]] for x in simhash.components(simhash.links(nodes)).collect()}
    slow = slow_components(list(enumerate(prints)))
    same = lambda of: {frozenset(j for j in slow if of(j) == of(i)) for i in slow}
    assert same(lambda i: parts.get(i, i)) == same(slow.get)


def test_exploded_tables_are_not_broadcast(spark):
    """Spark takes an exploded table for as small as the one before: 34 anchors for each fingerprint, a row for each shingle."""
    nodes = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    postings = spark.range(3000).select(F.col("id").alias("node"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.col("id") % 1000 * 40 + k)).alias("s"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        for found in (simhash.links(nodes), simhash.held_by_several(postings)):
            rows = found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert len(rows) == 120_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    parts = {x["node"]: x["component"] for x in simhash.components(edges).collect()}
    assert parts == {i: 0 for i in range(1, 41)} | {101: 100}


def test_simhash_edge_rows(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    found = simhash.near_duplicates(spark.createDataFrame(rows("a b c d", "a b c d", "zz", ids=[5, 5, None]), DOCS)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in found) == [(-1, None), (5, 5), (5, 5)]
    with pytest.raises(ValueError, match="three differing bits"):
        simhash.links(spark.createDataFrame([], "fp long, node long"), 4)


def test_rows_without_an_id_are_bridges(spark):
    """Fingerprints 0, 7 and 63 with the middle one's row without an id: it links the other two."""
    fps = {"a": 0, "b": 7, "c": 63}
    prints = spark.createDataFrame([(3, "a"), (None, "b"), (5, "c"), (None, "b")], "doc_id long, text string")
    real = simhash.simhash_udf
    simhash.simhash_udf = lambda c: F.when(c == "a", fps["a"]).when(c == "b", fps["b"]).otherwise(fps["c"]).cast("long")
    try:
        found = simhash.near_duplicates(prints).collect()
    finally:
        simhash.simhash_udf = real
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in found) == [("3", 3), ("5", 3), ("None", 3), ("None", 3)]


def words5(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("few", [8, 0])
def test_similar_groups_against_brute_force(spark, monkeypatch, few):
    """Copies with some words changed, and a passage that many texts share: the groups are those of all pairs of at least 0.8."""
    import random

    monkeypatch.setattr(simhash, "FEW_PAIRS", few)  # 0: rounds with leaders before the rest
    monkeypatch.setattr(simhash, "ORDER_SHARE", 2)
    r = random.Random(4)
    texts = []
    for base in range(30):
        words = [f"{r.choice('abcdefgh')}{r.randrange(400)}" for _ in range(150)]
        texts.append(" ".join(words))
        for changes in (1, 1, 2, 3, 3, 4, 12):
            copy = list(words)
            for at in r.sample(range(150), changes):
                copy[at] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{' '.join(f'q{r.randrange(10**6)}' for _ in range(n))} {passage}" for n in (3, 9, 10, 11, 12, 13, 14, 15, 40, 60) for _ in range(4)]
    texts += ["", None, "one two", "one two", "One  two", "x" * 100_000]
    found = {x["first"]: x["group"] for x in simhash.similar_groups(spark.createDataFrame(rows(*texts), DOCS), "doc_id").collect()}
    sets = {i: words5(t) for i, t in enumerate(texts)}
    linked = {i: i for i in found}

    def root(i):
        while linked[i] != i:
            i = linked[i]
        return i

    near = 0
    for i, j in itertools.combinations(sorted(found), 2):
        both = len(sets[i] & sets[j])
        if both and both / len(sets[i] | sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            linked[b] = a
            near += both / len(sets[i] | sets[j]) < 0.85
    assert near > 60
    assert found == {i: root(i) for i in found}
    end = len(texts) - 6
    assert end in found and end + 1 not in found and end + 2 in found and end + 3 not in found and end + 4 not in found


def test_shingle_sets(spark):
    for text in ("a b c d e f g", "A b", "", None, "a b c d e a b c d e a b c d e", " x\x0b y\n"):
        got = spark.createDataFrame([(text,)], "t string").select(simhash.shingle_set(F.col("t")).alias("s"), simhash.shingles_udf("t").alias("w")).first()
        assert len(got["s"]) == len(words5(text)) and set(got["s"]) == set(got["w"])


PHRASES = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}
LICENSED = [
    "Under the GNU General  Public-License! and the MIT\nlicense", None, "", "gnu general license public", "apache licenses", "cc by cc by", "Licensed under the Apache License, Version 2.0.",
    "word " * 500 + "MIT License " + "word " * 300 + "cc by", "émit license", "mit license" * 3, "x" * 100_000,
]


def slow_places(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, sorted(out)


def test_license_places(spark):
    data = rows(*LICENSED) + rows(*LICENSED, ids=range(100, 200))
    for r in license_scan.license_scan(spark.createDataFrame(data, DOCS)).collect():
        words, want = slow_places(LICENSED[r["doc_id"] % 100])
        assert r["n_words"] == len(words)
        assert [(p["start"], p["label"]) for p in r["places"]] == want
        assert {x for _, x in want} <= set(r["labels"])
        assert 0 <= r["score"] <= 1


def slow_met(text, templates):
    """Labels of notices that some block of their class meets, and the largest share, by counting every block."""
    words = slow_places(text)[0]
    met = {}
    for t in templates:
        stride = 16
        while stride < len(t.words):
            stride *= 2
        own = set(t.words)
        for at in range(0, len(words), stride):
            share = len(own & set(words[at : at + 2 * stride])) / len(own)
            if share >= t.threshold - 1e-9:
                met[t.label] = max(share, met.get(t.label, 0))
    return met


def test_license_containment_against_brute_force(spark):
    """Templates whole, with words lost or put in, cut, and in other text at every offset."""
    import random

    r = random.Random(6)
    texts = []
    for t in license_scan.NOTICES:
        for lost in (0.0, 0.05, 0.1, 0.15, 0.3):
            words = [w if r.random() >= lost else f"x{r.randrange(99)}" for w in t.words]
            pad = ["the", "of", "and"] + [f"y{k}" for k in range(r.randrange(0, 60))]
            texts.append(" ".join(pad + words + pad))
    data = rows(*texts, *LICENSED)
    found = {x["doc_id"]: x for x in license_scan.license_scan(spark.createDataFrame(data, DOCS)).collect()}
    for i, text, *_ in data:
        met, base = slow_met(text, license_scan.NOTICES), {label for _, label in slow_places(text)[1]}
        assert set(found[i]["labels"]) == set(met) | base, i
        assert found[i]["score"] == pytest.approx(1.0 if base else max(met.values(), default=0.0))
    assert sum(bool(slow_met(t, license_scan.NOTICES)) for t in texts) > 60


def test_license_templates_of_the_user(spark):
    """Clashing columns, ids of text, and tables too large to broadcast."""
    own = (license_scan.Template("house", "all rights kept by the house of words and nobody else", 0.8), license_scan.Template("draft", "not for print", 1.0, True))
    df = spark.createDataFrame([("a", "x All rights kept by THE house of words, nobody", 1, "s"), ("b", "not for print", 1, "s"), (None, None, 1, "s")], "doc_id string, text string, template int, words string")
    most, license_scan.joined.__globals__["BROADCAST_ROWS"] = license_scan.joined.__globals__["BROADCAST_ROWS"], 0
    try:
        found = {x["doc_id"]: (x["labels"], x["score"]) for x in license_scan.license_scan(df, own).collect()}
    finally:
        license_scan.joined.__globals__["BROADCAST_ROWS"] = most
    assert found == {"a": (["house"], pytest.approx(9 / 11)), "b": (["draft"], 1.0), None: ([], 0.0)}


def test_license_empty_and_same_rows(spark):
    assert license_scan.license_scan(spark.createDataFrame([], DOCS)).count() == 0
    assert license_scan.license_scan(spark.createDataFrame(rows("cc by", "cc by", ids=[1, 1]), DOCS)).count() == 2


PAGES = ["One. Two. Three.\nFour", "One. Two. Three.\nFour", "", None, "x" * 1000, "a\nb\n\nc", "näïve 😀 text. " * 9]


def test_merkle_query(spark, tmp_path):
    ids = [7, 300, 5, 64, 63, 1000, 9]
    spark.createDataFrame(rows(*PAGES, ids=ids), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op5_merkle(spark, str(tmp_path)).collect()}
    order = sorted(zip(ids, PAGES, strict=True), reverse=True)
    assert len(found) == len(ids)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (found[i]["fingerprint"] == found[i]["edited_fingerprint"]) == (text == edited)
        assert (found[i]["near_edited"] == 1.0) == (text == edited)
        assert 0 <= found[i]["near_next"] <= 1
    assert found[7]["fingerprint"] == found[300]["fingerprint"]
    assert len({r["fingerprint"] for r in found.values()}) == len({t or "" for t in PAGES})


def slow_tree(text):
    """(root, listing) by the definition, with plain strings."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    hashes, listed = "", ""
    for line in (text or "").split("\n"):
        cells, at = [], 0
        while at < len(line):
            end = next((k + 2 for k in range(at, min(at + 63, len(line) - 1)) if line[k] in ".!?;" and line[k + 1] in "\t\n\x0b\x0c\r "), at + 64)
            cells.append(sha(line[at:end]))
            at = end
        whole = sha("".join(cells))
        end = "|" if whole[0] in "08" else ","
        hashes, listed = hashes + whole + end, listed + "".join(c[:8] for c in cells) + end
    return sha(",".join(sha(s) for s in hashes[:-1].split("|")))[:32], listed[:-1]


def slow_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    x, y, same = set(a[1].split("|")), set(b[1].split("|")), 0
    for split in (lambda v: v.split(","), lambda v: [v[i : i + 8] for i in range(0, len(v), 8)], None):
        same += sum(len(v.replace(",", "")) / 8 for v in x & y)
        x, y = x - y, y - x
        if split:
            x, y = {p for v in x for p in split(v)}, {p for v in y for p in split(v)}
    return same / (same + max(1, len(x) + len(y)))


def test_merkle_against_brute_force(spark):
    import random

    r = random.Random(3)
    line = lambda: " ".join(f"w{r.randrange(30)}" + r.choice(["", "", ".", "!", ";"]) for _ in range(r.randrange(0, 40)))
    texts = [*PAGES]
    for _ in range(12):
        lines = [line() for _ in range(r.randrange(1, 60))]
        texts.append("\n".join(lines))
        lines[r.randrange(len(lines))] += " more"
        texts.append("\n".join(lines))
        texts.append("\n".join(["a new first line.", *lines]))
        texts.append("\n".join(reversed(lines)))
    df = merkle.merkle(spark.createDataFrame(rows(*texts), DOCS), "text", "p")
    trees = [slow_tree(t) for t in texts]
    assert {x["doc_id"]: x["p"] for x in df.collect()} == {i: f"{root}:{listing}" for i, (root, listing) in enumerate(trees)}
    pairs = df.select(F.col("doc_id").alias("i"), F.col("p").alias("a")).join(df.select(F.col("doc_id").alias("j"), F.col("p").alias("b")), F.expr("abs(i - j) < 4"))
    for x in pairs.select("i", "j", merkle.likeness(F.col("a"), F.col("b")).alias("l")).collect():
        assert x["l"] == pytest.approx(slow_likeness(trees[x["i"]], trees[x["j"]])), (x["i"], x["j"])


def test_merkle_locates_edits(spark):
    a = "\n".join(f"line {i}." for i in range(40))
    b = a.replace("line 17.", "LINE 17.").replace("line 3.", "line 3!")
    put_in, taken_out = "first of all\n" + a, a.replace("line 5.\n", "")
    df = spark.createDataFrame([(a, x) for x in (b, put_in, taken_out, a)], "a string, b string")
    df = merkle.merkle(merkle.merkle(df, "a", "ta"), "b", "tb")
    found = df.select(merkle.differing(F.col("ta"), F.col("tb")).alias("d"), merkle.likeness(F.col("ta"), F.col("tb")).alias("l")).collect()
    assert [r["d"] for r in found] == [[3, 17], [0], [], []]
    assert [r["l"] for r in found] == pytest.approx([38 / 42, 40 / 41, 39 / 40, 1.0])


@pytest.mark.parametrize("ids", [range(40), [i * i * 10**14 - 7 for i in range(40)], [*range(20), *range(1 << 62, (1 << 62) + 20)]])
def test_next_over_many_buckets(spark, ids):
    """Dense, sparse and clustered ids."""
    rows_of, merkle.BUCKET_ROWS = merkle.BUCKET_ROWS, 3
    try:
        found = merkle.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).collect()
    finally:
        merkle.BUCKET_ROWS = rows_of
    order = sorted(ids, reverse=True)
    assert {r["id"]: r["next_text"] for r in found} == {i: f"t{j}" for i, j in zip(order, [*order[1:], order[0]], strict=True)}
    assert len(found) == 40


def test_next_of_text_ids(spark):
    with pytest.raises(ValueError, match="whole-number"):
        merkle.with_next(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_next_of_few_and_null_ids(spark):
    one = merkle.with_next(spark.createDataFrame([(4, "abc")], "doc_id long, text string")).collect()
    assert [(r["id"], r["next_text"]) for r in one] == [(4, "abc")]
    some = merkle.with_next(spark.createDataFrame([(None, "n"), (1, "a"), (1, "a"), (900_000_000_000, "z"), (-5, None)], "doc_id long, text string")).collect()
    assert sorted((str(r["id"]), r["text"], r["next_text"]) for r in some) == [("-5", "", "z"), ("1", "a", ""), ("1", "a", "a"), ("900000000000", "z", "a"), ("None", "n", "")]
    assert merkle.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_groups_of_rows_without_keys(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [(None, " ".join(words)), (None, " ".join([*words[:-1], "other"])), (None, "quite another text"), (3, " ".join([*words[:-1], "third"])), (5, "apart")]
    found = simhash.similar_groups(spark.createDataFrame(texts, "k long, text string"), "k").collect()
    assert sorted((str(r["first"]), str(r["group"])) for r in found) == sorted([("None", "3"), ("None", "3"), ("3", "3"), ("None", "None"), ("5", "5")])


def test_pairs_compared_grow_with_a_group_of_near_copies(spark, monkeypatch):
    """Variants of one text, each like it and not like each other: one comparison links each, not one for each pair."""
    words, size = [f"w{i}" for i in range(150)], 150
    texts = [" ".join(words)]
    for k in range(size):
        own = list(words)
        for j in range(3):
            own[(7 * k + 48 * j + 5) % 140 + 5] = f"x{k}-{j}"
        texts.append(" ".join(own))
    compared, kept = [], simhash.checkpointed

    def counted(df):
        out = kept(df)
        if df.columns == ["a", "b"]:
            compared.append(out.count())
        return out

    monkeypatch.setattr(simhash, "checkpointed", counted)
    found = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "k").collect()
    assert len(found) == size + 1 and {x["group"] for x in found} == {0}
    assert sum(compared) < 4 * size


def test_sets_of_shingles_are_made_in_slices(spark):
    texts = [None, "", " \t", *(" ".join(f"w{k % 7}x{j}" for j in range(k % 40)) for k in range(2 * simhash.SLICE))]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string").coalesce(1)
    found = {r["node"]: r["set"] for r in simhash.shingle_sets(rows).collect()}
    assert found == {k: simhash.shingles_of(t)[0].view(np.int64).tolist() for k, t in enumerate(texts)} and found[0] == []
    # Spark keeps no rows with their texts waiting for the sets
    assert "ArrowEvalPython" not in simhash.shingle_sets(rows)._jdf.queryExecution().toString()
    assert simhash.shingle_sets(rows.limit(0)).count() == 0
