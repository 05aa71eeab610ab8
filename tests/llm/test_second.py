"""Language and toxicity once more, by plain loops: features, scores, decisions, and that the weights are the best."""

import bisect
import collections
import math
import re

import numpy as np
import pytest

from headway.llm import langid, queries, toxicity
from headway.llm.common import crc32_mod

SF = "/root/testdata/sf0.001"
FULL = (1 << 64) - 1
ODD = [(10**6, ""), (10**6 + 1, None), (10**6 + 2, "12 !?"), (10**6 + 3, "Ünïcode – “quoted” WORDS"), (10**6 + 4, "a"), (10**6 + 5, "日本語 text"), (10**6 + 6, "Women and men. She met a muslim girl!")]


@pytest.fixture(scope="module")
def docs(spark):
    return queries.table(spark, SF, "documents").select("doc_id", "text", "lang").unionByName(spark.createDataFrame(ODD, "doc_id long, text string"), allowMissingColumns=True)


def plain_grams(text, dimensions):
    letters = [" " if (ord(c) < 128 and not "a" <= c <= "z") or 0x2000 <= ord(c) < 0x2E00 else c for c in f" {text.lower()} "]
    line = "".join(c for c, before in zip(letters, ["", *letters]) if c != " " or before != " ")
    counts = collections.Counter()
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            h = ord(line[i]) * 0x9E3779B97F4A7C15 & FULL
            for c in line[i + 1 : i + n]:
                h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 + ord(c) * 0x94D049BB133111EB) & FULL
            counts[(h >> 40) % dimensions] += 1
    return counts


def test_languages_once_more(docs):
    model = langid.fit(docs.where(crc32_mod("doc_id", 3) != 1))
    rows = docs.collect()
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(found) == len(rows)
    close = 0
    for doc_id, text, _ in rows:
        got = found[doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (got["lang_pred"], got["score"], got["rejected"]) == ("und", 0.0, True)
            continue
        counts = plain_grams(text, len(model.idf))
        weights = {k: math.log1p(n) * float(model.idf[k]) for k, n in counts.items()}
        length = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[k]) for k, w in weights.items()) / length for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        language = int(model.owner[best])
        assert got["lang_pred"] == model.languages[language] and abs(got["score"] - min(1, max(0, cosines[best]))) < 1e-5
        limit = model.thresholds[language][bisect.bisect_left(langid.LENGTHS, sum(counts.values()))]
        close += abs(cosines[best] - limit) < 1e-6
        assert got["rejected"] == (cosines[best] <= limit) or abs(cosines[best] - limit) < 1e-6
    assert close < 3


def test_centroids_are_means_of_what_is_nearest():
    r = np.random.default_rng(2)
    x = r.random((200, 30))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = langid.spherical_means(x, 3, rounds=200)
    nearest = [max(range(3), key=lambda k: float(row @ c[k])) for row in x]
    for k in range(3):
        mean = np.mean([row for row, n in zip(x, nearest) if n == k], axis=0)
        assert np.allclose(c[k], mean / np.linalg.norm(mean), atol=1e-9)


def plain_score(model, text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    features = words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}
    z = model.bias + sum(float(model.weights[model.index[f]]) for f in features if f in model.index)
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def test_toxicity_once_more(spark, docs):
    labels = queries.table(spark, SF, "labels").where(crc32_mod("doc_id", 5) != 0)
    model = toxicity.fit(docs, labels)
    found = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for doc_id, text, _ in rows:
        assert abs(found[doc_id] - plain_score(model, text)) < 1e-9


def test_weights_are_the_best():
    """The penalised loss, written out, doesn't fall in any direction from the weights that solve gives."""
    r = np.random.default_rng(7)
    rows = [sorted(r.choice(12, r.integers(1, 6), replace=False).tolist()) for _ in range(80)]
    y = (r.random(80) < 0.4).astype(float)
    pairs = [(sorted(r.choice(12, 3, replace=False).tolist()), sorted(r.choice(12, 3, replace=False).tolist())) for _ in range(30)]
    w, b = toxicity.solve(rows, y, pairs, 12, counterfactual=5.0, rounds=4000)

    def loss(w, b):
        p = lambda at: 1 / (1 + math.exp(-(b + sum(w[i] for i in at))))
        fit = -sum(math.log(p(a)) if t else math.log(1 - p(a)) for a, t in zip(rows, y))
        return fit + toxicity.RIDGE / 2 * float(w @ w) + 5.0 * sum((p(a) - p(c)) ** 2 for a, c in pairs)

    at = loss(w, b)
    for k in range(12):
        for step in (0.02, -0.02):
            assert loss(w + step * np.eye(12)[k], b) > at - 1e-5
    assert loss(w, b + 0.02) > at - 1e-5 and loss(w, b - 0.02) > at - 1e-5
