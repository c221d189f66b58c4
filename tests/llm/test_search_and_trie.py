"""Lexical search, exact top-k and the conversation trie against brute force: nulls, ties, copies, empty tables, long texts, clashing names."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import lexical, neighbours, topk, trie
from quillmesh.llm.common import table
from tests.conftest import DATA, same_rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain_ranks(docs, items, k):
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    total, n_docs = sum(len(w) for _, w in held), len(held)
    out = set()
    for item, text in items:
        asked, scores = terms(text), []
        df = {w: sum(w in ws for _, ws in held) for w in asked}
        for i, ws in held:
            m = 75 + (25 * len(ws) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * ws.count(w)) // (1000 * ws.count(w) + 12 * m)) for w in asked if df[w])
            scores.append((-s, i is None, i or 0, i))
        out |= {(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(x for x in scores if x[0] < 0)[:k])}
    return out


@pytest.fixture(scope="module")
def words():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "été", "naïve", "ABC", "abc", "x1"]
    return lambda n: " ".join(rng.choice(vocabulary[: rng.randrange(2, len(vocabulary))]) for _ in range(n))


def test_lexical_is_the_brute_force(spark, words, monkeypatch):
    texts = [words(random.Random(i).randrange(1, 60)) for i in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(900, texts[3]), (901, texts[3]), (None, texts[3]), (3, texts[3]), (902, None), (903, ""), (904, "!? ."), (905, "w1 " * 40000 + "ABC"), (906, "w" * 300000)]
    items = [(i, words(8)) for i in range(12)] + [(50, texts[3]), (51, ""), (52, None), (53, "zzz nowhere"), (54, "w1 w1 w1, w2"), (54, "w3"), (55, "w" * 300000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("query", F.lit(1)).withColumn("TEXT_KEY", F.lit("x"))
    q = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("bound", F.lit(2))
    for first, batch, at_once in ((32, 2048, 256), (20, 5, 7)):  # small bounds: several rounds, several blocks
        for name, value in (("FIRST", first), ("BATCH", batch), ("ITEMS", at_once), ("SENT", 0 if batch == 5 else 1000)):
            monkeypatch.setattr(lexical, name, value)
        got = [tuple(r) for r in lexical.search(d, q, 20).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_ranks(docs, items, 20)
    assert lexical.search(d.limit(0), q).count() == lexical.search(d, q.limit(0)).count() == 0


def test_lexical_bounds_are_never_below_the_scores(spark, words):
    texts = [words(40) for _ in range(60)]
    q = lexical.Queries.of([words(10) for _ in range(5)])
    q.docs, q.length = 60, sum(len(terms(t)) for t in texts)
    import numpy as np

    q.weight = np.arange(1, len(q.terms) + 1)
    for first, count, doc, h in lexical.hashed(texts):
        n, cells = lexical.sketches(doc, h, count)
        for i in range(count):
            d, x, tf = lexical.frequencies(doc[doc == i], h[doc == i])
            hit, at = q.found(x)
            exact = q.scores(int(n[i]), at, tf[hit], np.arange(5))
            bound = q.bounds(n[i : i + 1], [cells[i]])[:, 0]
            assert (bound >= exact).all() and len(cells[i]) >= lexical.SLOTS * len(x)


def test_lexical_equals_sql(spark, duck):
    same_rows(lexical.op11_lexical(spark, DATA), duck, lexical.SQL)


def plain_topk(rows, k):
    good = sorted({(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v)})
    out = set()
    for own in sorted({i for i, _ in good if i % 50 == 0}):
        best = {}
        for _, a in [x for x in good if x[0] == own]:
            for i, b in good:
                if i != own and len(a) == len(b):
                    best[i] = max(best.get(i, -(2**64)), sum(x * y for x, y in zip(a, b, strict=True)))
        out |= {(own, r + 1, i, s) for r, (s, i) in enumerate(sorted(((-s, i) for i, s in best.items()))[:k])}
    return {(o, r, i, -s) for o, r, i, s in out}


def test_topk_is_the_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(1, 260)]
    rows += [(i, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(5)]) for i in range(300, 340)]  # ties, another length
    rows += [(400 + i, rows[0][1]) for i in range(60)] + [(50, rows[0][1]), rows[49], (600, None), (650, [1.0, None]), (700, [float("nan")] * 12), (750, [float("inf")] * 12), (800, []), (None, rows[0][1]), (850, [2.0] * 3), (1000, [0.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "c": F.lit(2), "ids": F.lit(3)})
    want = plain_topk(rows, 5)
    for lists, gathered, block in ((2, 16, 4096), (4, 2, 32), (1, 8, 50)):
        for name, value in (("GATHER", gathered), ("ROWS", block), ("QUERIES", block)):
            monkeypatch.setattr(topk, name, value)
        got = [(r.query_id, r.rank, r.id, r.score) for r in topk.search(df, F.col("id") % 50 == 0, 5, lists=lists).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert topk.search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    few = [(r.query_id, r.id) for r in topk.search(df.where("vec_id IN (50, 7)"), F.col("id") % 50 == 0).collect()]
    assert few == [(50, 7)]


def test_topk_of_large_numbers(spark):
    big = float(2**40)
    df = spark.createDataFrame([(50, [big, 1.0]), (1, [big, 2.0]), (2, [-big, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.id, r.score) for r in topk.search(df, F.col("id") == 50).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, (2**48 + 256) * 256), (2, -(2**63))]


def test_topk_equals_sql(spark, duck):
    same_rows(topk.op12_topk(spark, DATA), duck, topk.SQL)


def test_neighbours_search_each_length_and_fill_their_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4 if i % 3 else 6)]) for i in range(1, 91)] + [(900, [1.0]), (901, [0.0, 0.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("id") % 5 == 0).collect()
    size = {i: len(v) for i, v in rows}
    assert len(got) == 18 * 5 and all(size[r.query_id] == size[r.id] and r.id != r.query_id for r in got)


def test_neighbours_recall_on_the_table(spark):
    found = {}
    for r in neighbours.op3_neighbours(spark, DATA).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [(r.vec_id, r.embedding) for r in table(spark, DATA, "embeddings").collect()]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    hits = [len(found[i] & {j for _, j in sorted((-cosine(v, w), j) for j, w in rows if j != i)[:5]}) for i, v in rows if i % 50 == 0]
    assert len(hits) == len(found) and sum(hits) >= 0.9 * 5 * len(hits)


def plain_trie(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    convs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(v[:d], []).append(c)
    kids = {p: [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p] for p in nodes}
    below = lambda p: [q for q in nodes if q[: len(p)] == p]
    return {
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below(p)), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below(p) if q),
         hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if convs[c] == p)).encode()).hexdigest())
        for p, m in nodes.items()
    }


TRIE = "conv_id long, turn long, role string, text string"


def plain_rows(df):
    return {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()}


def test_trie_is_the_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "ccc é", None, ""])) for c in [*range(60), *range(100, 160), 200, 205, 317, 411] for t in range(rng.randrange(1, 9))]
    rows += [(500, t, "user", "same") for t in range(40)] + [(600 + i, t, "user", "same") for i in range(30) for t in range(i % 12 + 1)]  # chains: each a prefix of others
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (8, 1, "x", "tie"), (8, 1, "x", "tie"), (None, 0, "user", "nobody"), (700, 0, "u", "z" * 50000)]
    assert len({c for c, *_ in rows}) > 150
    spark.createDataFrame(rows, TRIE).withColumns({"x": F.lit(1), "a": F.lit(2), "D": F.lit(3)}).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    want = plain_trie(rows)
    for chunk, first, span, run in ((4096, 8, 1024, 8192), (3, 2, 4, 2)):
        for name, value in (("CHUNK", chunk), ("FIRST", first), ("SPAN", span), ("RUN", run)):
            monkeypatch.setattr(trie, name, value)
        out = trie.op13_trie(spark, str(tmp_path))
        assert plain_rows(out) == want and out.count() == len(want)


def test_trie_of_no_conversations_and_of_turnless_ones(spark, tmp_path):
    for name, rows in (("none", []), ("nobody", [(None, 1, "a", "b")]), ("turnless", [(c, 0, "a", "b") for c in range(1, 40)])):
        spark.createDataFrame(rows, TRIE).write.parquet(str(tmp_path / name / "conversations.parquet"))
        assert plain_rows(trie.op13_trie(spark, str(tmp_path / name))) == plain_trie(rows)


def test_two_fattest_numbers(spark):
    pairs = [(lo, hi) for lo in range(40) for hi in range(lo + 1, 41)]
    best = lambda lo, hi: max(range(lo + 1, hi + 1), key=lambda x: x & -x)
    got = spark.createDataFrame(pairs, "low long, high long").select("low", "high", trie.fattest("low", "high").alias("f")).collect()
    assert all(r.f == best(r.low, r.high) for r in got)


def test_trie_equals_sql(spark, duck):
    same_rows(trie.op13_trie(spark, DATA), duck, trie.SQL)
