"""Toxicity: logistic regression on words, regularised by counterfactuals.

Features are a text's distinct words and their first four and five letters. From a bounded
sample of labelled texts, those are kept whose presence depends on the label beyond chance (G
test, with a limit that grows with the number of features tested). The fit penalises, besides
large weights, every change of score between a labelled sentence and its counterfactual, in
which identity terms are swapped for other terms of their list; a sentence without such a term
is compared with itself plus a mention. So a mention of a group alone moves no score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Terms for groups of people that may stand for each other.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "hispanic", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "native", "foreign"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
)
#: Labelled texts to learn from, at most (in expectation).
LEARN_ROWS = 8_000
#: Weights of the two penalties.
RIDGE, COUNTERFACTUAL = 0.3, 20.0
WORD = re.compile(r"[^\W\d_]+")
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}
MENTIONS = [g[0] for g in IDENTITY]


def features_of(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return words | {f"^{w[:n]}" for w in words for n in (4, 5) if len(w) > n}


def swapped(sentence: str) -> str:
    return WORD.sub(lambda m: SWAP.get(m[0].lower(), m[0]), sentence)


def counterfactuals(text: str | None, key: str) -> Iterator[tuple[str, str]]:
    """A text's sentences with identity terms and their counterparts; if it has none, one sentence and itself plus a mention."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n", text or "") if WORD.search(s)]
    named = [s for s in sentences if not SWAP.keys().isdisjoint(WORD.findall(s.lower()))]
    for s in named:
        yield s, swapped(s)
    if not named and sentences:
        yield sentences[0], f"{sentences[0]} {MENTIONS[zlib.crc32(key.encode()) % len(MENTIONS)]}"


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        get = self.index.get
        at = [i for f in features_of(text) if (i := get(f)) is not None]
        return sigmoid(self.bias + float(self.weights[at].sum()))


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def g_statistic(n: pd.Series, toxic: pd.Series, rows: int, toxic_rows: int) -> pd.Series:
    """How far presence of a feature depends on the label: G of its two-by-two table."""
    total = 0.0
    for seen, expected in ((toxic, n * toxic_rows / rows), (n - toxic, n * (rows - toxic_rows) / rows),
                           (toxic_rows - toxic, (rows - n) * toxic_rows / rows), (rows - toxic_rows - n + toxic, (rows - n) * (rows - toxic_rows) / rows)):
        total = total + 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
    return total


def solve(
    rows: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], width: int, counterfactual: float = COUNTERFACTUAL, rounds: int = 400
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss + ridge + counterfactual penalty, by accelerated gradient steps."""
    def sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter((i for x in lists for i in x), np.int64)

    at, col = sparse(rows)
    left, right = sparse([a for a, _ in pairs]), sparse([b for _, b in pairs])
    sums = lambda where, w, n: np.bincount(where[0], w[where[1]], minlength=n)
    back = lambda where, g: np.bincount(where[1], g[where[0]], minlength=width)
    p = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    x, n, m = (at, col), len(rows), len(pairs)
    w, b = np.zeros(width), 0.0
    # adam: the same step size suits features of any frequency
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        miss = p(sums(x, w, n) + b) - y
        grad, grad_b = back(x, miss) + RIDGE * w, miss.sum()
        if m:
            pa, pb = p(sums(left, w, m) + b), p(sums(right, w, m) + b)
            d = 2 * counterfactual * (pa - pb)
            ga, gb = d * pa * (1 - pa), -d * pb * (1 - pb)
            grad, grad_b = grad + back(left, ga) + back(right, gb), grad_b + ga.sum() + gb.sum()
        g = np.append(grad, grad_b) / n
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        step = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(
    docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, counterfactual: float = COUNTERFACTUAL,
    id_col: str = "doc_id", text_col: str = "text",
) -> Model:
    """A model from about learn_rows labelled texts, picked by a hash of the id; without labels it scores 0.

    A document with several labels is toxic if one of them says so. Ids may be of any type; rows
    without an id have no label. Columns other than id and text, toxic in labels, are ignored.
    The features are as many as pass the test; they come from the learning texts, so learn_rows
    bounds them. counterfactual is the weight of the penalty on score changes; 0 leaves it out.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("key"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and key is not null")
    picked = sampled(known, learn_rows, known.count(), 3, "key").groupBy("key").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(picked), "key").select("key", "toxic", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"].array, batch["toxic"].array, strict=True):
                found = features_of(text)
                found.add("")  # stands for the rows
                n.update(found)
                if label:
                    toxic.update(found)
        yield pd.DataFrame([(f, k, toxic[f]) for f, k in n.items()], columns=["feature", "n", "toxic"])

    counts = sample.mapInPandas(count, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    tested = counts.where("n >= 3 or feature = ''").toPandas()
    whole = tested[tested["feature"] == ""]
    if whole.empty or not 0 < int(whole["toxic"].iloc[0]) < int(whole["n"].iloc[0]):
        return Model({}, np.zeros(0), -30.0 if whole.empty or not int(whole["toxic"].iloc[0]) else 0.0)
    rows, toxic_rows = int(whole["n"].iloc[0]), int(whole["toxic"].iloc[0])
    tested = tested[tested["feature"] != ""]
    tested = tested.assign(g=g_statistic(tested["n"], tested["toxic"], rows, toxic_rows)).sort_values(["g", "feature"], ascending=[False, True])
    chosen = tested[tested["g"] > 2 * math.log(max(2, len(tested)))]
    terms = sorted({f for t in SWAP for f in features_of(t)} - set(chosen["feature"]))
    index = {f: i for i, f in enumerate([*chosen["feature"], *terms])}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = lambda s: sorted(index[f] for f in features_of(s) if f in index)
        for batch in batches:
            out = []
            for key, text, label in zip(batch["key"].array, batch["text"].array, batch["toxic"].array, strict=True):
                out.append((key, label, numbers(text), None))
                out += [(key, label, numbers(a), numbers(b)) for a, b in counterfactuals(text, key)]
            yield pd.DataFrame(out, columns=["key", "toxic", "a", "b"])

    encoded = sample.mapInPandas(encode, "key string, toxic int, a array<int>, b array<int>").toPandas()
    lists = [(k, int(t), list(a), None if b is None else list(b)) for k, t, a, b in zip(*(encoded[c] for c in ("key", "toxic", "a", "b")), strict=True)]
    lists.sort(key=lambda r: (r[0], r[3] is not None, r[2], r[3] or []))
    texts = [(a, t) for _, t, a, b in lists if b is None]
    pairs = [(a, b) for _, _, a, b in lists if b is not None and a != b]
    w, b = solve([a for a, _ in texts], np.array([t for _, t in texts], float), pairs, len(index), counterfactual)
    return Model(index, w, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs -> id, columns named in keep, score (0 to 1), for each row of docs; null and empty texts have no features."""
    @F.pandas_udf("double")
    def rate(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts.array], dtype="float64")

    return docs.select(id_col, *keep, rate(F.col(text_col)).alias("score"))
