"""Ranked lexical search: hashed max-sketches bound every document's score, exact rescoring goes down the bounds.

* Index, independent of the queries: each document folds its term frequencies, from which its
  impacts follow, into coordinatewise maxima. A term has two of the sketch's slots, by two halves of
  its hash; a slot keeps the largest frequency (up to 255, which stands for any more) of the terms
  that meet there. A sketch has the next power of two from SLOTS times the document's distinct terms.
* Batched lookups: for a block of queries, every document's sketch is read at all their terms at
  once. The smaller of a term's two slots is never below its frequency, so the weighted sum of the
  impacts is an upper bound of the score.
* The FIRST best bounds of each query are rescored exactly from the whole texts; the last of the
  best scores is the query's threshold. All other documents whose bound reaches it are rescored in
  descending batches of bounds, each raising the threshold, until no bound reaches it.

Terms are maximal runs of letters, digits and code points from 128 on, with A to Z lower-cased, and
are known by 64-bit hashes (two different terms of one query and a corpus of 10^10 terms are taken
for each other with a chance of about 10^-9 each). Scores are integers, as the contract has them.

Documents with equal texts share a score and are rescored once; of equal scores the smaller doc_id
comes first, null ids last. Each row is a document, repeated rows too. Texts that are null or
without terms take no part. Queries without terms get no rows; equal (item, text) rows count once,
rows of one item with different texts are asked, and ranked, each by itself. No rows: no rows.

Queries come in blocks of about ITEMS and CHARS characters, which are what is sent to all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, text_key, written
from .shingles import Powers, mix

SLOTS, FIRST, BATCH = 8, 32, 2048
ITEMS, CHARS = 256, 4_000_000
#: Pairs that may be broadcast; beyond it they are joined by a shuffle.
SENT = 200_000
CHUNK = 1 << 18  # bytes of text hashed at once
TERMS, CELLS = 4096, 1 << 22  # terms looked up, and slots held, at once
QUANTILES = (0.999, 0.99, 0.9, 0.5)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def parts(data: bytes) -> Iterator[bytes]:
    """A long text in pieces of about CHUNK bytes, cut between terms only."""
    at = 0
    while len(data) - at > CHUNK:
        tail = np.nonzero(~IN_TERM[np.frombuffer(data, np.uint8, CHUNK, at)])[0]
        to = at + int(tail[-1]) + 1 if len(tail) else at + CHUNK
        while not len(tail) and to < len(data) and IN_TERM[data[to - 1]]:  # one term longer than a piece
            to += 1
        yield data[at:to]
        at = to
    yield data[at:]


def term_hashes(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Start of each term and its 64-bit hash."""
    b = LOWER[np.frombuffer(data, dtype=np.uint8)]
    if not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    up, down = powers.get(len(b))
    edge = np.diff(np.concatenate(([False], IN_TERM[b], [False])).astype(np.int8))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    return start, mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hashed(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, number, document, hash) for runs of texts: the terms of each of them, documents counted from the first."""
    powers, at = Powers(), 0
    while at < len(texts):
        first, size, own, pieces = at, 0, [], []
        while at < len(texts) and (at == first or size < CHUNK):
            data = (texts[at] or "").encode("utf-8", "replace")
            for p in parts(data):
                own.append(at - first)
                pieces.append(p)
            size += len(data) + 1
            at += 1
        docs, hashes, lo = [], [], 0
        while lo < len(pieces):
            hi, run = lo, 0
            while hi < len(pieces) and (hi == lo or run < CHUNK):
                run += len(pieces[hi]) + 1
                hi += 1
            start, h = term_hashes(b" ".join(pieces[lo:hi]), powers)
            bounds = np.cumsum([len(p) + 1 for p in pieces[lo:hi]])
            docs.append(np.array(own[lo:hi], dtype=np.int64)[np.searchsorted(bounds, start, side="right")])
            hashes.append(h)
            lo = hi
        yield first, at - first, np.concatenate(docs), np.concatenate(hashes)


def frequencies(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, frequency) of the distinct terms of each document, in this order."""
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    new = np.nonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]))))[0] if len(d) else np.zeros(0, dtype=np.int64)
    return d[new], x[new], np.diff(np.concatenate((new, [len(d)])))


def sketches(doc: np.ndarray, h: np.ndarray, count: int) -> tuple[np.ndarray, list[bytes]]:
    """Terms, and the sketch, of each of count documents."""
    d, x, tf = frequencies(doc, h)
    size = np.ones(count, dtype=np.int64)
    some = np.bincount(d, minlength=count)
    size[some > 0] = 2 ** np.ceil(np.log2(SLOTS * some[some > 0])).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    cells = np.zeros(at[-1], dtype=np.uint8)
    for half in (x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)):
        np.maximum.at(cells, at[d] + (half.astype(np.int64) & (size[d] - 1)), np.minimum(tf, 255).astype(np.uint8))
    return np.bincount(doc, minlength=count), [cells[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n, sketch) of each row of docs that has terms, written down."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, count, doc, h in hashed(b.column(2).to_pylist()):
                n, cells = sketches(doc, h, count)
                part = b.slice(first, count)
                keep = pa.array(n > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(cells, pa.binary())], ["id", "text_key", "n", "sketch"]).filter(keep)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return written(rows.mapInArrow(build, "id long, text_key string, n long, sketch binary"), "sketches")


@dataclass
class Queries:
    """A block of queries: its distinct terms, and for each pair of a query and a term its repeats."""

    terms: np.ndarray  # sorted hashes
    query: np.ndarray
    term: np.ndarray
    repeats: np.ndarray
    count: int
    weight: np.ndarray | None = None  # of each term
    docs: int = 0
    length: int = 1

    @staticmethod
    def of(texts: list[str]) -> Queries:
        q, h, n = [], [], []
        for first, _, doc, x in hashed(texts):
            d, x, tf = frequencies(doc, x)
            q.append(d + first)
            h.append(x)
            n.append(tf)
        terms, at = np.unique(np.concatenate(h), return_inverse=True)
        return Queries(terms, np.concatenate(q), at, np.concatenate(n), len(texts))

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, position in terms) of the hashes that are terms of the queries."""
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = np.nonzero(self.terms[at] == h)[0]
        return hit, at[hit]

    def divisor(self, n: np.ndarray) -> np.ndarray:
        return 12 * (75 + (25 * n * self.docs) // self.length)

    def bounds(self, n: np.ndarray, cells: list[bytes]) -> np.ndarray:
        """(queries, documents): upper bounds of the scores; all documents have sketches of one size."""
        size, tf = len(cells[0]), np.arange(256, dtype=np.int64)
        impact = (1_000_000_000 * tf // (1000 * tf + self.divisor(n)[:, None])).astype(np.float32)
        impact[:, 255] = 1_000_000
        slots = np.ascontiguousarray(np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), size).T)
        low, high = (self.terms & np.uint64(0xFFFFFFFF)).astype(np.int64) & (size - 1), (self.terms >> np.uint64(32)).astype(np.int64) & (size - 1)
        out = np.zeros((self.count, len(cells)))
        for a in range(0, len(self.terms), TERMS):
            b = min(a + TERMS, len(self.terms))
            seen = np.minimum(slots[low[a:b]], slots[high[a:b]])
            t, d = np.nonzero(seen)
            x = np.zeros(seen.shape, dtype=np.float32)
            x[t, d] = impact[d, seen[t, d]]
            mine = np.nonzero((self.term >= a) & (self.term < b))[0]
            w = np.zeros((self.count, b - a), dtype=np.float32)
            w[self.query[mine], self.term[mine] - a] = (self.repeats * self.weight[self.term])[mine]
            out += w @ x
        return out * (1 + (TERMS + 16) * 2.0**-23) + 1  # more than the rounding of the sums

    def scores(self, n: int, term: np.ndarray, tf: np.ndarray, of: np.ndarray) -> np.ndarray:
        """The exact scores of one document, with the given frequencies of the terms, for the queries named."""
        full = np.zeros(len(self.terms), dtype=np.int64)
        tf = tf.astype(np.int64)
        full[term] = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + int(self.divisor(np.array([n]))[0])))
        each = np.zeros(self.count, dtype=np.int64)
        np.add.at(each, self.query, self.repeats * full[self.term])
        return each[of]


def document_counts(docs: DataFrame, text_col: str, q: Queries) -> np.ndarray:
    """In how many documents each term of the queries is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q.terms), dtype=np.int64)
        for b in batches:
            for _, _, doc, h in hashed(b.column(0).to_pylist()):
                hit, at = q.found(h)
                _, t = np.divmod(np.unique(doc[hit] * len(q.terms) + at), len(q.terms))
                total += np.bincount(t, minlength=len(total))
        some = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["term", "df"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term of the block
    out = np.zeros(len(q.terms), dtype=np.int64)
    out[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return out


PAIR = "query int, text_key string, bound double"


def bounded(rows: DataFrame, q: Queries, least: np.ndarray | None) -> DataFrame:
    """(query, text_key, bound): each task's FIRST best of every query, or all that reach least."""

    def best(bound: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if bound.shape[1] <= FIRST:
            return bound, np.broadcast_to(keys, bound.shape) if keys.ndim == 1 else keys
        top = np.argpartition(-bound, FIRST - 1, axis=1)[:, :FIRST]
        return np.take_along_axis(bound, top, 1), keys[top] if keys.ndim == 1 else np.take_along_axis(keys, top, 1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, named = np.zeros((q.count, 0)), np.zeros((q.count, 0), dtype=object)
        for b in batches:
            keys, n, cells = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_numpy(), b.column(2).to_pylist()
            _, once = np.unique(keys.astype(str), return_index=True)  # copies of a text have the same bound
            size = np.array([len(cells[i]) for i in once])
            for s in np.unique(size):
                own = once[size == s]
                step = max(1, min(1024, CELLS // int(s)))
                for lo in range(0, len(own), step):
                    at = own[lo : lo + step]
                    u = q.bounds(n[at], [cells[i] for i in at])
                    if least is None:
                        nb, nk = best(u, keys[at])
                        bound, named = best(np.hstack((bound, nb)), np.hstack((named, nk)))
                    else:
                        i, d = np.nonzero(u >= np.maximum(least, 2)[:, None])
                        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(keys[at][d], pa.string()), pa.array(u[i, d])], ["query", "text_key", "bound"])
        i, d = np.nonzero(bound >= 2)  # a bound of an impossible score is 1
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(named[i, d], pa.string()), pa.array(bound[i, d], pa.float64())], ["query", "text_key", "bound"])

    return rows.select("text_key", "n", "sketch").mapInArrow(look, PAIR).groupBy("query", "text_key").agg(F.max("bound").alias("bound"))


def rescored(docs: DataFrame, text_col: str, pairs: DataFrame, number: int, q: Queries) -> DataFrame:
    """(query, text_key, score): exact scores of the pairs, from the whole texts, written down."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, asked = b.column(0).to_pylist(), b.column(2).to_pylist()
            for first, count, doc, h in hashed(b.column(1).to_pylist()):
                n = np.bincount(doc, minlength=count)
                hit, at = q.found(h)
                d, t, tf = frequencies(doc[hit], at.astype(np.uint64))
                edge = np.searchsorted(d, np.arange(count + 1))
                for i in range(count):
                    of = np.array(asked[first + i])
                    lo, hi = edge[i], edge[i + 1]
                    got = q.scores(int(n[i]), t[lo:hi].astype(np.int64), tf[lo:hi], of)
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([keys[first + i]] * len(of)), pa.array(got, pa.int64())], ["query", "text_key", "score"])

    named = pairs.groupBy("text_key").agg(F.collect_list("query").alias("asked")).hint("broadcast" if number <= SENT else "merge")  # a block's queries at most in a list
    rows = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return written(rows.join(named, "text_key").select("text_key", "text", "asked").mapInArrow(score, "query int, text_key string, score long").distinct(), "scores")


def thresholds(scores: list[DataFrame], k: int, count: int) -> np.ndarray:
    """The k-th best score so far of each query, or 0."""
    every = scores[0]
    for s in scores[1:]:
        every = every.unionByName(s)
    last = every.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "text_key"))).where(F.col("r") == k)
    out = np.zeros(count, dtype=np.int64)
    for r in last.select("query", "score").collect():  # a row for each query of the block
        out[r["query"]] = r["score"]
    return out


def reach(pairs: DataFrame, least: np.ndarray) -> DataFrame:
    """The pairs whose bound is at least the query's entry, one number for each query of the block."""
    return pairs.where(F.col("bound") >= F.get(F.array(*[F.lit(float(x)) for x in least]), F.col("query")))


def block(docs: DataFrame, sketched: DataFrame, texts: list[str], k: int, text_col: str, size: tuple[int, int]) -> DataFrame | None:
    """(query, text_key, score) of the texts that can be among the k best of a block of queries."""
    q = Queries.of(texts)
    if not len(q.terms):
        return None
    q.docs, q.length = size
    df = document_counts(docs, text_col, q)
    q.weight = np.array([math.floor(1000 * math.log((2 * q.docs + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "text_key")
    first = bounded(sketched, q, None).withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRST).drop("r")
    first = written(first, "first")
    scores = [rescored(docs, text_col, first, q.count * FIRST, q)]
    least = thresholds(scores, k, q.count)
    live = written(bounded(sketched, q, least).join(first.select("query", "text_key").hint("broadcast"), ["query", "text_key"], "left_anti"), "rest")  # first has FIRST rows a query at most
    while True:
        live = reach(live, least)
        open_ = live.groupBy("query").agg(F.count("*").alias("n"), F.percentile_approx("bound", list(QUANTILES), 10000).alias("at")).collect()  # a row for each query of the block
        if not open_:
            break
        level, number = np.full(q.count, 0.0), 0
        for r in open_:
            fits = [x for p, x in zip(QUANTILES, r["at"], strict=True) if r["n"] * (1 - p) <= BATCH]
            level[r["query"]] = 0.0 if r["n"] <= BATCH else (fits[-1] if fits else r["at"][0])
            number += r["n"]
        scores.append(rescored(docs, text_col, reach(live, level), number, q))
        if not level.any():
            break
        least = np.maximum(least, thresholds(scores, k, q.count))
        live = written(live.where(F.col("bound") < F.get(F.array(*[F.lit(float(x)) for x in level]), F.col("query"))), "rest")
    every = scores[0]
    for s in scores[1:]:
        every = every.unionByName(s)
    least = thresholds(scores, k, q.count)
    return every.where((F.col("score") > 0) & (F.col("score") >= F.get(F.array(*[F.lit(int(x)) for x in least]), F.col("query"))))


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """(query_id, rank, id, score): the k highest-scoring documents of each query."""
    spark = docs.sparkSession
    sketched = index(docs, id_col, text_col)
    one = sketched.agg(F.count("*").alias("docs"), F.sum("n").alias("length")).first()
    asked = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_col).cast("string").alias("query_text")).where("query_text IS NOT NULL").distinct()
    asked = written(asked, "queries")
    many = asked.agg(F.count("*").alias("n"), F.sum(F.length("query_text")).alias("chars")).first()
    kind = asked.schema["query_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"query_id {kind}, rank int, id long, score long")
    if not one["docs"] or not many["n"]:
        return out
    blocks = max(-(-many["n"] // ITEMS), -(-many["chars"] // CHARS), 1)
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id", "query_text"), F.lit(blocks)) == b).orderBy("query_id", "query_text").collect()  # one block
        best = block(docs, sketched, [r["query_text"] for r in rows], k, text_col, (one["docs"], one["length"])) if rows else None
        if best is None:
            continue
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], f"query int, query_id {kind}")
        hits = sketched.select("id", "text_key").join(best.hint("merge"), "text_key")
        top = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "query").select("query_id", "rank", "id", "score")  # one block
        found = top if found is None else found.unionByName(top)
    return out if found is None else found


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


RUNS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORDS = f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{RUNS}')"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS ws FROM documents WHERE text IS NOT NULL),
  e AS (SELECT r, doc_id, len(ws) AS n, ws FROM d WHERE len(ws) > 0), g AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM e),
  t AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM e) GROUP BY r, w), f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
  q AS (SELECT item_id, w, count(*) AS repeats FROM (SELECT item_id, unnest({WORDS}) AS w FROM benchmark) GROUP BY item_id, w),
  s AS (SELECT item_id, r, sum(repeats * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
        FROM q JOIN f USING (w) JOIN t USING (w) JOIN e USING (r), g GROUP BY item_id, r),
  o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s JOIN e USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20"""
