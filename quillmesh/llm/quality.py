"""Quality classifier: naive Bayes support vectors.

A document is a set of n-gram indicators: byte n-grams up to three, and n-grams up to three of
"this word repeats the one before". Each indicator is scaled by its log-count ratio between the
classes, a linear hinge-loss model is fitted by dual coordinate descent on the scaled
indicators, and Platt's sigmoid, fitted on rows that the descent hasn't seen, turns margins into
scores.

Bounded sample: at most LABELLED labelled rows of the learning folds, those with the smallest
hashes; at most WIDTH indicators, the most frequent there. Null and empty texts have no
indicators and get the score of the intercept. Repeated rows stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_bucket, fresh, table, whole
from .labelled import arrays, labelled_ids

LABELLED, WIDTH, LEAST = 8000, 12000, 5
SEED = 31
#: Codes: one byte below 2^8, two above 2^8, three above 2^16, repetition patterns from SHAPES on.
SHAPES = 1 << 24


def codes(text: str) -> np.ndarray:
    """The codes of the n-grams of a text, repeats included."""
    b = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.int32)
    words = text.split()
    same = np.fromiter((x == y for x, y in zip(words, words[1:], strict=False)), dtype=np.int32, count=max(0, len(words) - 1))
    out = [b]
    if len(b) > 1:
        out.append(b[:-1] * 256 + b[1:])
    if len(b) > 2:
        out.append((b[:-2] * 256 + b[1:-1]) * 256 + b[2:])
    for n, base in ((1, 2), (2, 4), (3, 8)):
        if len(same) >= n:
            out.append(SHAPES + base + sum(same[i : len(same) - n + 1 + i] << (n - 1 - i) for i in range(n)))
    return np.concatenate(out)


class Model:
    """Chosen codes in ascending order, their log-count ratios and hinge weights, the intercept and the sigmoid."""

    def __init__(self, chosen: np.ndarray, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.chosen, self.ratio, self.weights, self.bias, self.slope, self.shift = chosen, ratio, weights, bias, slope, shift

    def margin(self, at: np.ndarray) -> float:
        """Of a text with the indicators at these places: as in the descent, they are scaled by ratio and to length 1."""
        r = self.ratio[at]
        return float(self.weights[at] @ r / (math.sqrt(float(r @ r)) or 1.0) + self.bias)

    def scores(self, texts: list[str]) -> np.ndarray:
        place = np.zeros(SHAPES + 16, dtype=np.int32)  # 0: not chosen
        place[self.chosen] = np.arange(1, len(self.chosen) + 1)
        out = np.empty(len(texts))
        seen = np.zeros(len(self.chosen) + 1, dtype=bool)
        for i, t in enumerate(texts):
            seen[:] = False
            seen[place[codes(t)]] = True
            out[i] = self.margin(np.nonzero(seen[1:])[0])
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))


def count_ratio(rows: list[np.ndarray], y: np.ndarray, width: int, alpha: float = 1.0) -> np.ndarray:
    """log of (share of the positive mass) over (share of the negative mass) for each indicator."""
    p, q = np.full(width, alpha), np.full(width, alpha)
    for r, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[r] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; rows are indicator sets, scaled by ratio and to length 1. Classes weigh the same."""
    n = len(rows)
    w, b, a = np.zeros(len(ratio)), 0.0, np.zeros(n)
    length = [math.sqrt(float((ratio[r] ** 2).sum())) or 1.0 for r in rows]
    values = [ratio[r] / k for r, k in zip(rows, length, strict=True)]
    diag = np.array([float((v**2).sum()) for v in values]) + 1.0  # the intercept is a constant indicator
    share = {s: n / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    rng = np.random.default_rng(SEED)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(n):
            g = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(a[i] - g / diag[i], 0.0), cost * share[int(y[i])])
            if (d := new - a[i]) != 0:
                a[i] = new
                w[rows[i]] += d * y[i] * values[i]
                b += d * y[i]
                most = max(most, abs(d))
        if most < 1e-4:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid, by Newton steps on Platt's smoothed targets."""
    pos, neg = int((y > 0).sum()), int((y < 0).sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    s, c = 1.0, math.log((pos + 1) / (neg + 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(s * margin + c, -30, 30)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * margin).sum() + 1e-3 * s, r.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        step *= min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        s, c = s - step[0], c - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(s), 1e-3), float(c)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """No labels of one of the classes: every score is the share of the other, smoothed."""
    d = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    ids = labelled_ids(labels, label_col, LABELLED, SEED)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"].astype(str), "label": b["label"], "found": [np.unique(codes(t)) for t in b["text"]]})

    rows = d.join(F.broadcast(ids), "id").mapInPandas(read, "id string, label int, found array<int>").persist()  # LABELLED ids at most
    try:
        frequent = rows.select(F.explode("found").alias("code")).groupBy("code").count().where(F.col("count") >= LEAST)
        chosen = np.array(sorted(r["code"] for r in frequent.orderBy(F.desc("count"), "code").limit(WIDTH).collect()), dtype=np.int64)

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = [np.nonzero(np.isin(chosen, f, assume_unique=True))[0].astype(np.int32) for f in b["found"]]
                yield pd.DataFrame({"id": b["id"], "label": b["label"], "at": at})

        label, x = arrays(rows.mapInPandas(coded, "id string, label int, at array<int>"), "label")
    finally:
        rows.unpersist()
    y = np.where(label > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0), 0.0, 1.0, math.log(((y > 0).sum() + 1) / ((y < 0).sum() + 1)))
    aside = np.arange(len(y)) % 5 == 4
    inner = [i for i in range(len(y)) if not aside[i]]
    if len(set(y[inner].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        inner, aside = list(range(len(y))), np.ones(len(y), dtype=bool)
    ratio = count_ratio([x[i] for i in inner], y[inner], len(chosen))
    w, b = descend([x[i] for i in inner], y[inner], ratio)
    model = Model(chosen, ratio, w, b, 1.0, 0.0)
    model.slope, model.shift = platt(np.array([model.margin(x[i]) for i in np.nonzero(aside)[0]]), y[aside])
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher for better text; if docs has a column of that name, the new one gets underscores in front."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.scores(list(b)), dtype="float64")

    return docs.withColumn(fresh(docs, score_col)[0], score(whole(F.col(text_col))))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
