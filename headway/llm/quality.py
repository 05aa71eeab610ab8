"""Quality rules: a decision list learned by sequential covering, as Spark conditionals.

Statistics of whole texts are columns. From labelled rows, rules are learned one by one: a rule
grows threshold by threshold on two thirds of the rows while FOIL's gain is positive, is pruned
on the other third, and is kept if it is precise there; the rows it covers are then set aside.
The result is an ordered list of conjunctions and becomes F.when(...).when(...).otherwise(...).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Labelled rows that a list is learned from, at most (in expectation).
LEARN_ROWS = 12_000
#: A rule is kept if so many of the rows that it covers are bad, and so many rows at least are covered.
MIN_PRECISION, MIN_COVER = 0.9, 4
#: How many thresholds are tried for a feature, at even quantiles of the bad rows. Rules and their
#: conditions have no limit: growing ends where no condition gains, covering where no rule is precise.
THRESHOLDS = 24
COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct",
]


def repeated_words(ids: np.ndarray) -> int:
    """Words in 3-word windows that are found twice or more; ids are below len(ids)."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1] if n >= 1 << 21 else ids[:-1] * n + ids[1:]
    _, which, counts = np.unique(pairs[:-1] * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def counts_of(text: str | None) -> list[int]:
    """COUNTS of a text; null has no words."""
    if not text:
        return [0] * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter(map(seen.setdefault, words, range(len(words))), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=128)
    marks = int(by[33:48].sum() + by[58:65].sum() + by[91:97].sum() + by[123:127].sum())
    return [
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(ids), len(lines), int(by[65:91].sum()), int(by[97:123].sum()), int(by[48:58].sum()), marks, len(seen),
    ]


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_udf(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counts_of(t) for t in texts.array], columns=COUNTS, dtype="int64")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """docs -> id, the columns named in keep, and COUNTS of the whole text, for each row; other columns are ignored."""
    return docs.select(F.col(id_col), *keep, counts_udf(F.col(text_col)).alias("__counts")).select(id_col, *keep, "__counts.*")


def features() -> dict[str, Column]:
    """What thresholds are put on: shares and means that don't depend on a text's length, and a few counts."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    cased = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": F.col("n_upper") / cased,
        "digit_share": share("n_digits", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "distinct_share": share("n_distinct", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = features()[self.feature]
        return c > self.threshold if self.above else c <= self.threshold

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold


def covers(rule: list[Condition], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= c.mask(x)
    return out


def candidates(x: dict[str, np.ndarray], rows: np.ndarray, thresholds: int) -> Iterator[Condition]:
    for name, values in x.items():
        for t in np.unique(np.quantile(values[rows], np.linspace(0, 1, thresholds + 2)[1:-1])):
            yield Condition(name, True, float(t))
            yield Condition(name, False, float(t))


def grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, thresholds: int = THRESHOLDS) -> list[Condition]:
    rule: list[Condition] = []
    inside = rows.copy()
    while (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not p0:
            break
        best, gain = None, 1e-9
        # thresholds at the quantiles of the bad rows, where a rare kind would escape those of all
        for c in candidates(x, inside & bad, thresholds):
            m = c.mask(x) & inside
            p = bad[m].sum()
            n = m.sum() - p
            if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule.append(best)
        inside &= best.mask(x)
    return rule


def prune(rule: list[Condition], x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> list[Condition]:
    def worth(r: list[Condition]) -> float:
        m = covers(r, x, len(bad)) & rows
        p = bad[m].sum()
        return (2 * p - m.sum()) / max(1, m.sum())

    return max((rule[: k + 1] for k in range(len(rule))), key=lambda r: (worth(r), -len(r)), default=rule)


def learn_rules(
    x: dict[str, np.ndarray], bad: np.ndarray, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER, thresholds: int = THRESHOLDS
) -> list[list[Condition]]:
    """Rules for bad rows, in order. x: a column of numbers for each feature."""
    left, rules = np.ones(len(bad), bool), []
    third = np.arange(len(bad)) % 3 == 2
    while rule := grow(x, bad, left & ~third, thresholds):
        rule = prune(rule, x, bad, left & third)
        m = covers(rule, x, len(bad)) & left
        tested = m & third
        if m.sum() < min_cover or bad[m].mean() < min_precision or tested.any() and bad[tested].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~m
    return rules


def fit(
    docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text", thresholds: int = THRESHOLDS
) -> list[list[Condition]]:
    """The rules for label quality = 0, from about learn_rows labelled documents at most, picked by a hash of the id.

    Ids may be of any type; rows without an id have no label. A document with several labels
    counts by its lowest. Columns other than id and text, quality in labels, are ignored.
    """
    known = labels.select(F.col("doc_id").cast("string").alias("key"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality is not null and key is not null")
    picked = sampled(known, learn_rows, known.count(), 9, "key").groupBy("key").agg(F.min("quality").alias("quality"))
    texts = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(picked), "key")
    named = features()
    counted = text_counts(chosen, "key", "text", keep=("quality",)).where(~base_failed())
    rows = counted.select("key", "quality", *(c.alias(k) for k, c in named.items())).toPandas()
    rows = rows.sort_values(["key", *named], kind="stable")
    return learn_rules({k: rows[k].to_numpy(float) for k in named}, rows["quality"].to_numpy() == 0, thresholds=thresholds)


def verdict(rules: list[list[Condition]]) -> Column:
    """True where no rule holds: an ordered conditional, one branch for each rule."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)) if out is None else out.when(holds, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def score_quality(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (id, text) -> id, COUNTS, base_failed, kept; a row for each row of docs.

    Null and empty texts have no words and fail. Without labels nothing is learned, and base
    failures alone are rejected.
    """
    rules = fit(docs, labels, learn_rows, id_col, text_col)
    return text_counts(docs, id_col, text_col).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
