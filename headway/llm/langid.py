"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed letter n-grams (one to three code points, words padded with
blanks), weighted by log frequency and inverse document frequency and scaled to length one. Each
language has CENTROIDS centroids, found by spherical k-means on a bounded sample of labelled
texts. A text takes the language of the centroid with the largest cosine.

It is rejected where that cosine lies below the threshold of its language and length. Thresholds
come from learning texts that the centroids haven't seen (every fourth is kept apart), whole and
cut to lengths: the REJECT_QUANTILE of their cosines, less a margin of REJECT_MARGIN times the
distance from there to the median. Texts of known languages lie above, those of other languages
and strings of random letters mostly below; very short texts can't be told apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fraction

DIMENSIONS = 4096
CENTROIDS = 3
#: Learning texts: of a language and of all languages, at most (in expectation).
SAMPLE, SAMPLE_ALL = 600, 12_000
REJECT_QUANTILE, REJECT_MARGIN = 0.1, 3.5
#: Numbers of n-grams that part texts into classes of length, and characters that learning texts are cut to.
LENGTHS = (12, 24, 48, 96, 192, 384)
CUTS = (3, 7, 12, 24, 48, 96, 192)
#: Code points that are worked on at once; n-grams over the seam are counted.
CHUNK = 1 << 20
UNKNOWN = "und"


def letters(points: np.ndarray) -> np.ndarray:
    """Code points of small letters as they are; 32 for other ASCII characters and general punctuation."""
    plain = (points < 0x80) & ~((points >= 97) & (points <= 122)) | (points >= 0x2000) & (points < 0x2E00)
    return np.where(plain, np.uint32(32), points)


def grams(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the whole lower-cased text between blanks; runs of blanks count once."""
    out = np.zeros(dimensions, np.float64)
    whole = f" {text.lower()} "
    carried = np.zeros(0, np.uint64)
    for at in range(0, len(whole), CHUNK):
        p = letters(np.frombuffer(whole[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")).astype(np.uint64)
        before = np.concatenate((carried[-1:] if len(carried) else np.zeros(1, np.uint64), p[:-1]))
        p = np.concatenate((carried, p[(p != 32) | (before != 32)]))
        h = p * np.uint64(0x9E3779B97F4A7C15)
        for n in (1, 2, 3):
            if n > 1:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + p[n - 1 :] * np.uint64(0x94D049BB133111EB)
            new = h[max(0, len(carried) - n + 1) :]  # those that end within what was carried are counted already
            out += np.bincount((new >> np.uint64(40)).astype(np.int64) % dimensions, minlength=dimensions)
        carried = p[-2:]
    return out


def sparse(counts: np.ndarray) -> bytes:
    """Counts as bytes: the places that aren't zero, then their values."""
    at = np.flatnonzero(counts)
    return zlib.compress(at.astype("<u4").tobytes() + counts[at].astype("<f4").tobytes(), 1)


def dense(data: bytes, dimensions: int) -> np.ndarray:
    held = zlib.decompress(data)
    half = len(held) // 2
    out = np.zeros(dimensions, np.float32)
    out[np.frombuffer(held[:half], "<u4")] = np.frombuffer(held[half:], "<f4")
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, of length one
    owner: np.ndarray  # index of the language of each centroid
    thresholds: np.ndarray  # by language and class of length

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, whether it is rejected."""
        cosines = self.vectors(counts) @ self.centroids.T
        best = cosines.argmax(axis=1)
        cosine = cosines[np.arange(len(best)), best]
        language = self.owner[best]
        return language, cosine, cosine <= self.thresholds[language, length_class(counts.sum(axis=1))]


def length_class(n_grams: np.ndarray) -> np.ndarray:
    return np.searchsorted(LENGTHS, n_grams)


def spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centres of the rows of x; starts from the mean and then the row farthest from all so far."""
    unit = lambda c: c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-12)
    centres = [unit(x.mean(axis=0))]
    while len(centres) < min(k, len(x)):
        centres.append(x[(x @ np.array(centres).T).max(axis=1).argmin()])
    c = np.array(centres)
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        c = np.array([unit(x[nearest == i].mean(axis=0)) if (nearest == i).any() else c[i] for i in range(len(c))])
    return c


def thresholds(model: Model, language: int, pieces: list[np.ndarray]) -> None:
    """Sets the thresholds of a language from counts of texts that its centroids were not made of."""
    counts = np.stack(pieces)
    own = model.centroids[model.owner == language]
    cosines = (model.vectors(counts) @ own.T).max(axis=1)
    classes = length_class(counts.sum(axis=1))
    for k in range(len(LENGTHS) + 1):
        inside = cosines[classes == k]
        if len(inside) and k:
            low, middle = np.quantile(inside, [REJECT_QUANTILE, 0.5])
            model.thresholds[language, k] = max(0.0, low - REJECT_MARGIN * (middle - low))
    # of a class without learning texts: that of the next shorter one with some
    for k in range(1, len(LENGTHS) + 1):
        if not (classes == k).any():
            model.thresholds[language, k] = model.thresholds[language, k - 1]


def fit(
    docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, dimensions: int = DIMENSIONS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_all: int = SAMPLE_ALL,
) -> Model | None:
    """A model from about sample texts of each language, sample_all of all; None without labels.

    Texts are picked by a hash of id and text. Of each a few hundred numbers reach the driver,
    whole texts don't.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return None
    each = min(sample, max(8, sample_all // len(totals)))
    share = F.create_map(*(F.lit(v) for lang, n in totals.items() for v in (lang, min(1.0, each / n))))
    picked = rows.where(fraction(5, "id", "text") < share[F.col("lang")])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                parts = [[text, *(text[:n] for n in CUTS if n < len(text))] for text in b["text"]]
                yield pd.DataFrame({"id": b["id"], "lang": b["lang"], "counts": [[sparse(grams(t, dimensions)) for t in p] for p in parts]})

    found = picked.mapInPandas(count, "id string, lang string, counts array<binary>").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["lang", "id"], kind="stable").reset_index(drop=True)
    whole = np.stack([dense(c[0], dimensions) for c in found["counts"]])
    languages = sorted(found["lang"].unique())
    idf = np.log((1 + len(whole)) / (1 + (whole > 0).sum(axis=0))) + 0.1
    model = Model(languages, idf.astype(np.float32), np.zeros((0, dimensions)), np.zeros(0, int), np.zeros((len(languages), len(LENGTHS) + 1)))
    x = model.vectors(whole).astype(np.float32)
    apart = np.zeros(len(found), bool)
    parts = []
    for lang in languages:
        own = np.flatnonzero((found["lang"] == lang).to_numpy())
        seen = own if len(own) < 8 else own[np.arange(len(own)) % 4 != 3]
        apart[own if len(own) < 8 else np.setdiff1d(own, seen)] = True
        parts.append(spherical_means(x[seen], centroids))
    model.centroids, model.owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    for k, lang in enumerate(languages):
        own = found[apart & (found["lang"] == lang).to_numpy()]
        thresholds(model, k, [dense(c, dimensions) for cs in own["counts"] for c in cs])
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs -> id, columns named in keep, lang_pred, score (the cosine, 0 to 1), rejected; for each row of docs.

    lang_pred is `und` with score 0, rejected, where the text is null or has no letter, or where
    there is no model. A text far from all centroids keeps its nearest language, and is rejected.
    """
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        parts = []
        for at in range(0, len(texts), 512):
            some = texts.array[at : at + 512]
            lettered = np.array([model is not None and t is not None and any(map(str.isalpha, t)) for t in some], bool)
            out = pd.DataFrame({"lang_pred": pd.Series([UNKNOWN] * len(some), dtype=object), "score": 0.0, "rejected": True})
            if lettered.any():
                language, cosine, rejected = model.predict(np.stack([grams(t, len(model.idf)) for t in some[lettered]]))
                out.loc[lettered, "lang_pred"] = np.array(model.languages, object)[language]
                out.loc[lettered, "score"] = np.clip(cosine, 0, 1)
                out.loc[lettered, "rejected"] = rejected
            parts.append(out)
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    found = docs.select(F.col(id_col), *keep, predict(F.col(text_col)).alias("__found"))
    return found.select(id_col, *keep, "__found.*")
