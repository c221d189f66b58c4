"""Toxicity by weak supervision.

Voters look at each document: fixed lexicons, patterns, and lexicons of words and word
beginnings mined from two thirds of the labelled rows. A generative label model is fitted by EM on
how often each pattern of votes occurs over all documents: a hidden class, an accuracy for each
voter, and a tree of the strongest correlations between voters given the class (so that voters
that say the same don't count twice). The other third, on which nothing was mined, has its class given there, so that accuracies aren't those on the mined rows. The model's
posteriors, for labelled rows too, train a logistic model on word and word-beginning indicators,
which scores every document.

Bounded samples: at most LABELLED labelled rows of the learning folds, and UNLABELLED further
documents of these folds, those with the smallest hashes. Null and empty texts have no features;
they get the score of the intercept. Repeated rows stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_bucket, fresh, table, whole
from .labelled import arrays, labelled_ids

LABELLED, UNLABELLED, FEATURES, MINED = 8000, 2000, 20000, 4000
SEED = 29
WORD = re.compile(r"[^\W\d_]+")
LENGTHS = (3, 4, 5, 6)

# Lexicons and patterns of the voters, in lower case.
INSULTS = frozenset("idiot idiots moron morons stupid dumb fool imbecile loser losers clown clowns scum trash garbage jerk bastard pig vermin parasite retard dimwit halfwit".split())
CONTEMPT = frozenset("pathetic worthless disgusting vile filthy repulsive despicable revolting useless hideous wretched contemptible".split())
PROFANITY = frozenset("fuck fucking shit bitch asshole cunt whore slut damn crap arschloch scheisse idioten dumm hurensohn connard salope merde idiote idiota estúpido puta mierda cabrón imbécil".split())
PHRASES = re.compile(r"\b(?:shut up|go to hell|kill yourself|i hate you|drop dead|you people|get lost|screw you)\b")
VOTERS = ("insults", "contempt", "profanity", "phrases", "shouting", "mined word", *(f"mined {k}" for k in LENGTHS), "dense")
TOXIC, CLEAN, ABSTAIN = 0, 1, 2


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def indicators(distinct: set[str]) -> set[str]:
    """Words, and beginnings of longer words marked by a star."""
    out = set(distinct)
    for k in LENGTHS:
        out.update(w[:k] + "*" for w in distinct if len(w) > k)
    return out


def shouts(text: str, window: int = 2000) -> bool:
    """Whether capitals are more than half of any window of so many characters (of the whole text, if that is shorter)."""
    n = min(window, len(text))
    so_far = np.concatenate(([0], np.cumsum(np.fromiter(map(str.isupper, text), dtype=np.int64, count=len(text)))))
    return bool((so_far[n:] - so_far[: len(so_far) - n]).max() > 0.5 * max(1, n))


class Lexicon:
    """Words, and word beginnings with a star, found in a text by whole sets: most words of a corpus are rare, so little is gained by keeping answers for each."""

    def __init__(self, features: Iterable[str]):
        self.words = {f for f in features if not f.endswith("*")}
        self.begun = {k: {f[:k] for f in features if f.endswith("*") and len(f) == k + 1} for k in LENGTHS}

    def found(self, distinct: set[str]) -> list[set[str]]:
        """The words, and the beginnings of each length, that stand in a text with these words."""
        return [distinct & self.words, *({w[:k] for w in distinct if len(w) > k} & self.begun[k] if self.begun[k] else set() for k in LENGTHS)]

    def features(self, distinct: set[str]) -> list[str]:
        words, *begun = self.found(distinct)
        return [*words, *(f + "*" for fs in begun for f in fs)]


class Voters:
    """The votes of all voters on a text; mined: words, and word beginnings with a star."""

    def __init__(self, mined: set[str]):
        self.mined = Lexicon(mined)

    def __call__(self, text: str) -> str:
        """A digit for each voter: 0 toxic, 1 clean, 2 abstains."""
        low = text.lower()
        words = WORD.findall(low)
        distinct = set(words)
        out = [TOXIC if distinct & lexicon else ABSTAIN for lexicon in (INSULTS, CONTEMPT, PROFANITY)]
        out.append(TOXIC if PHRASES.search(low) else ABSTAIN)
        out.append(TOXIC if "!" in text and shouts(text) else ABSTAIN)
        found = self.mined.found(distinct)
        out += [TOXIC if f else CLEAN for f in found]
        dense = 0.0
        if any(found):
            hit = {w for w in distinct if w in found[0] or any(len(w) > k and w[:k] in f for k, f in zip(LENGTHS, found[1:], strict=True))}
            dense = sum(w in hit for w in words) / len(words)
        out.append(TOXIC if dense > 0.005 else ABSTAIN if any(found) else CLEAN)
        return "".join(map(str, out))


def votes(text: str, mined: set[str]) -> str:
    return Voters(mined)(text)


class LabelModel:
    """P(class) and P(vote | class, vote of the parent in the tree of correlations)."""

    def __init__(self, patterns: list[str], gold: list[int | None], counts: list[float]):
        self.x = np.array([[int(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), len(VOTERS))
        self.n, self.gold = np.array(counts, dtype=float), gold
        self.parents: list[int | None] = [None] * len(VOTERS)
        self.fit()

    def clamp(self, p: np.ndarray) -> np.ndarray:
        known = np.array([g is not None for g in self.gold])
        return np.where(known, [float(g or 0) for g in self.gold], p) if len(p) else p

    def fit(self, rounds: int = 30) -> None:
        toxic, clean = (self.x == TOXIC).sum(1), (self.x == CLEAN).sum(1)
        p = self.clamp((toxic + 0.2) / (toxic + clean + 2.0))
        for i in range(rounds):
            if i in (5, 15):
                self.parents = self.tree(p)
            self.prior = min(0.99, max(0.01, (self.n @ p + 1) / (self.n.sum() + 2)))
            self.tables = [self.count(j, self.parents[j], p) for j in range(len(VOTERS))]
            p = self.clamp(self.posterior(self.x))

    def count(self, j: int, parent: int | None, p: np.ndarray) -> np.ndarray:
        """Smoothed [class, vote of the parent, vote]."""
        up = self.x[:, parent] if parent is not None else np.zeros(len(self.x), dtype=np.int64)
        t = np.full((2, 3, 3), 0.1)
        np.add.at(t, (0, up, self.x[:, j]), self.n * (1 - p))
        np.add.at(t, (1, up, self.x[:, j]), self.n * p)
        return t / t.sum(2, keepdims=True)

    def tree(self, p: np.ndarray) -> list[int | None]:
        """Chow-Liu: the tree of the largest mutual information between votes, given the class."""
        m = len(VOTERS)
        gain = np.zeros((m, m))
        for a in range(m):
            for b in range(a):
                for w in (self.n * p, self.n * (1 - p)):
                    joint = np.full((3, 3), 1e-6)
                    np.add.at(joint, (self.x[:, a], self.x[:, b]), w)
                    q = joint / joint.sum()
                    gain[a, b] += w.sum() / max(1.0, self.n.sum()) * (q * np.log(q / (q.sum(1, keepdims=True) * q.sum(0)))).sum()
        gain = np.maximum(gain, gain.T)
        parents: list[int | None] = [None] * m
        inside = {0}
        while len(inside) < m:
            score, a, b = max((gain[a, b], -a, -b) for a in inside for b in range(m) if b not in inside)
            parents[-b] = -a if score > 1e-3 else None
            inside.add(-b)
        return parents

    def posterior(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), math.log(self.prior / (1 - self.prior)))
        for j, t in enumerate(self.tables):
            up = x[:, self.parents[j]] if self.parents[j] is not None else np.zeros(len(x), dtype=np.int64)
            s += np.log(t[1, up, x[:, j]]) - np.log(t[0, up, x[:, j]])
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

    def of(self, pattern: str) -> float:
        return float(self.posterior(np.array([[int(c) for c in pattern]]))[0])

    def accuracies(self) -> dict[str, float]:
        """Share of a voter's votes that agree with the posterior class."""
        p, out = self.clamp(self.posterior(self.x)), {}
        for j, name in enumerate(VOTERS):
            right = self.n @ np.where(self.x[:, j] == TOXIC, p, np.where(self.x[:, j] == CLEAN, 1 - p, 0))
            out[name] = float(right / max(1e-9, self.n @ (self.x[:, j] != ABSTAIN)))
        return out


def tallies(rows: Iterator[tuple[str, float]], bound: int = 1 << 19) -> Iterator[pd.DataFrame]:
    """(feature, hit, n) of rows (text, weight): how many texts have an indicator, and their weight; summed up in the task as far as bound entries go."""
    sums: dict[str, list[float]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame({"feature": np.array(list(sums), dtype=object), "hit": [x[0] for x in sums.values()], "n": [int(x[1]) for x in sums.values()]})
        sums.clear()
        return out

    for text, weight in rows:
        for f in indicators(set(tokens(text))):
            x = sums.setdefault(f, [0.0, 0])
            x[0] += weight
            x[1] += 1
        if len(sums) > bound:
            yield flush()
    if sums:
        yield flush()


def mine(sample: DataFrame) -> set[str]:
    """Indicators that stand in at least 4 toxic documents of the sample (text, label), and in few clean ones."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from tallies((t, float(y)) for b in batches for t, y in zip(b["text"], b["label"], strict=True))

    counts = sample.select("text", "label").mapInPandas(found, "feature string, hit double, n long").groupBy("feature").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    sure = counts.where((F.col("hit") >= 4) & (F.col("hit") >= 0.92 * F.col("n")))
    return {r["feature"] for r in sure.orderBy(F.desc("hit"), "feature").limit(MINED).collect()}


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = Lexicon(weights)

    def score(self, text: str) -> float:
        s = self.bias + math.fsum(self.weights[f] for f in self.known.features(set(tokens(text))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))


def logistic(rows: list[np.ndarray], y: np.ndarray, width: int, l2: float = 1.0, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept on indicator rows with soft targets: accelerated gradient steps, ridge penalty l2."""
    if not len(rows):
        return np.zeros(width), -2.0
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int64)
    # each row is scaled to length 1 for the step size; the scale is undone by a common factor
    scale = 1 / math.sqrt(max(1.0, float(np.median([len(r) for r in rows]))))
    w, b, v, vb = np.zeros(width), 0.0, np.zeros(width), 0.0
    for i in range(rounds):
        m = 0.9 if i else 0.0
        lw, lb = w + m * v, b + m * vb
        p = 1 / (1 + np.exp(-np.clip(scale * np.bincount(of, lw[at], len(rows)) + lb, -30, 30)))
        g = scale * np.bincount(at, (p - y)[of], width) + l2 * 1e-3 * lw
        v, vb = m * v - 4.0 / len(rows) * 8 * g, m * vb - 4.0 / len(rows) * (p - y).sum()
        w, b = w + v, b + vb
    return scale * w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Model, LabelModel]:
    """The linear model, and the label model whose posteriors it learned."""
    d = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    ids = labelled_ids(labels, label_col, LABELLED, SEED).persist()
    try:
        mined = mine(d.join(F.broadcast(ids.where(for_mining())), "id"))  # LABELLED rows at most
        gold = F.broadcast(ids.where(~for_mining()))

        def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            voters = Voters(mined)
            for b in batches:
                yield pd.DataFrame({"pattern": [voters(t) for t in b["text"]], "label": b["label"]})

        every = d.join(gold, "id", "left").select("text", F.col("label").cast("double").alias("label"))
        counted = every.mapInPandas(vote, "pattern string, label double").groupBy("pattern", "label").count()
        counts = sorted(counted.collect(), key=lambda r: (r["pattern"], -1 if r["label"] is None else r["label"]))  # at most 3 to the number of voters
        model = LabelModel([r["pattern"] for r in counts], [None if r["label"] is None or math.isnan(r["label"]) else int(r["label"]) for r in counts], [r["count"] for r in counts])

        order = F.xxhash64(F.lit(SEED + 1), "id")
        more = d.where(fold_bucket(F.col("id")) != 0).select("id").where(F.col("id").isNotNull()).distinct().join(F.broadcast(ids), "id", "left_anti").orderBy(order, "id").limit(UNLABELLED)
        train = d.join(F.broadcast(ids.select("id").unionByName(more)), "id").select("id", "text")  # LABELLED + UNLABELLED ids at most
        return Model(*learn(train, mined, model)), model
    finally:
        ids.unpersist()


def for_mining() -> Column:
    """The labelled rows that lexicons are mined from: two thirds."""
    return F.pmod(F.xxhash64(F.lit(SEED + 2), "id"), F.lit(3)) > 0


def learn(train: DataFrame, mined: set[str], label_model: LabelModel) -> tuple[dict[str, float], float]:
    """Weights and intercept, from (id, text) and the posteriors of the votes on each text."""

    def aim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(mined)
        for b in batches:
            yield pd.DataFrame({"id": b["id"].astype(str), "text": b["text"], "y": [label_model.of(voters(t)) for t in b["text"]]})

    rows = train.mapInPandas(aim, "id string, text string, y double").persist()
    try:

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from tallies((t, y) for b in batches for t, y in zip(b["text"], b["y"], strict=True))

        each = rows.mapInPandas(count, "feature string, hit double, n long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
        total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("hit")).first()
        rate = (total["hit"] or 0.0) / max(1, total["n"])
        strength = F.round(F.abs(F.col("hit") - rate * F.col("n")) / F.sqrt(F.col("n") * (rate * (1 - rate) + 1e-6)), 6)
        names = [r["feature"] for r in each.where("n >= 3").orderBy(strength.desc(), "feature").limit(FEATURES).collect()]
        index = {f: i for i, f in enumerate(names)}

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Lexicon(index)
            for b in batches:
                yield pd.DataFrame({"id": b["id"], "y": b["y"], "at": [sorted(index[f] for f in known.features(set(tokens(t)))) for t in b["text"]]})

        y, found = arrays(rows.mapInPandas(coded, "id string, y double, at array<int>"), "y")
    finally:
        rows.unpersist()
    w, b = logistic(found, y, len(names))
    return {f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-6}, float(b)


def scored(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; if docs has a column of that name, the new one gets underscores in front."""
    weights, bias = model.weights, model.bias

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = Model(weights, bias)
        for text in batches:
            yield pd.Series([m.score(t) for t in text], dtype="float64")

    return docs.withColumn(fresh(docs, score_col)[0], score(whole(F.col(text_col))))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below the threshold; all columns and repeated rows stay."""
    (s,) = fresh(docs, "toxicity")
    return scored(docs, fit(docs, labels)[0], score_col=s).where(F.col(s) < threshold).drop(s)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels"))[0])
    return out.select("doc_id", (fold_bucket(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
