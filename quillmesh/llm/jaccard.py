"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Which pairs of texts have word-shingle sets (five words, lower case) with a Jaccard similarity
of at least THRESHOLD?

1. Exact copies become one text. Each text gets TREES x DEPTH MinHash values: its path in each
   tree of the forest.
2. Paths are dealt out by their first values and sorted, so that each task holds whole subtries of
   a tree, in which the nodes of every depth are runs of rows. Neighbours in this order are
   compared by signature first; a subtrie whose rows hang together is done with that. In another,
   more than ENOUGH near rows in one node at full depth keep their long prefix, but for one of them
   that speaks for the node; for that one and for all other rows the prefix is shortened to that of
   the subtrie, all of whose rows they are compared with, in blocks of about NODE_BLOCK. Links found are reduced to edges, so no node emits all its
   pairs. The components of the edges are families.
3. The first prefix is the longest that finds pairs at the threshold with chance TARGET. Then the
   recall is measured: the signatures of SAMPLE texts are compared with those of all. Below RECALL,
   texts without a link try again with a prefix shorter by one value, and if that isn't enough all
   texts do. Where even prefixes of one value fall short, a warning says what was reached.
4. Each family's shingle sets are brought together, again in blocks (of BLOCK texts or BLOCK_BYTES
   of text), and compared exactly. Links are counted for each text and reduced to edges, whose
   components are the classes.

Null texts count as empty. A text of one to four words is one shingle; a text without words has
no link, but its copies are one class. Repeated rows and hot copies cost one row in the group.
No documents: no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, marked, marks, table, text_key, whole, written
from .components import components
from .shingles import shingle_sets

THRESHOLD, TARGET = 0.8, 0.9995
TREES, DEPTH = 24, 6
MARGIN = 0.14  # signature estimates have a standard deviation of 0.033 at the threshold; texts that fall short by less than this are compared exactly
ENOUGH = 3  # near rows at full depth with which a row's prefix isn't shortened
SAMPLE, RECALL = 128, 0.99
NODE_BLOCK, BLOCK, BLOCK_BYTES = 512, 512, 1 << 21  # of a block when signatures, and when whole sets are compared
SEED = 41
#: Bits of the map that tells rows that can't be members from the rest, so that these aren't shuffled; a full map only lets more through.
MAP_BITS = 1 << 24


def factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 2048):
        part = x[lo : lo + 2048]
        np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def signed(docs: DataFrame) -> DataFrame:
    """(id, key, bytes, sig, fine) of (id, text): the length, the signature, and its low bytes for estimates; null for a text without words."""

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = factors()
        for batch in batches:
            sigs, fine = [], []
            for found in shingle_sets(list(batch["text"])):
                values = signature(found, a, b) if len(found) else None
                sigs.append(values.tobytes() if len(found) else None)
                fine.append((values & np.uint16(255)).astype(np.uint8).tobytes() if len(found) else None)
            yield pd.DataFrame({"id": batch["id"], "key": batch["key"], "bytes": batch["bytes"].astype("int32"), "sig": sigs, "fine": fine})

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", text_key(F.col("text")).alias("key"), F.octet_length("text").alias("bytes")).mapInPandas(one, f"id {kind}, key string, bytes int, sig binary, fine binary")


def short(key: Column) -> Column:
    """64 bits of a key. Where two keys share them, both become candidates; no decision rests on them."""
    return F.xxhash64(key)


def chance(s: float | np.ndarray, length: int) -> float | np.ndarray:
    """That texts of similarity s share a prefix in some tree."""
    return 1 - (1 - s**length) ** TREES


def first_length(threshold: float, target: float) -> int:
    length = DEPTH
    while length > 1 and chance(threshold, length) < target:
        length -= 1
    return length


def groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of rows sorted by the columns of by, many at once: the rows, and where each group begins. A group may span batches."""

    def begins(rows: pd.DataFrame) -> np.ndarray:
        change = np.zeros(len(rows), dtype=bool)
        for c in by:
            v = rows[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        change[0] = True
        return np.nonzero(change)[0]

    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        start = begins(batch)
        goes_on = bool(rest) and all(rest[-1][c].iloc[-1] == batch[c].iloc[0] for c in by)
        if goes_on and len(start) == 1:
            rest.append(batch)
            continue
        done = pd.concat([*rest, batch.iloc[: start[-1]]], ignore_index=True) if rest else batch.iloc[: start[-1]].reset_index(drop=True)
        rest = [batch.iloc[start[-1] :]]
        if len(done):
            yield done, begins(done)
    if rest:
        done = pd.concat(rest, ignore_index=True)
        yield done, begins(done)


def paired(rows: DataFrame, group: str, blocks: Column, node: str, order: list[str], tasks: int) -> DataFrame:
    """rows with (i, j, own): each row in every pair of blocks of its group that holds it; sorted within (group, i, j)."""
    own = F.pmod(F.xxhash64(node), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), (blocks - 1).cast("int")), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"), own.alias("own")))
    out = rows.withColumn("pair", F.explode(pairs)).select("*", "pair.*").drop("pair")
    return out.repartition(tasks, group, "i", "j").sortWithinPartitions(group, "i", "j", *order)


def roots(near: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric boolean matrix, the smallest row that it is connected with."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of signatures a to each of b, in slices of bounded size."""
    out = np.empty((len(a), len(b)), dtype=np.float32)
    for lo in range(0, len(a), 64):
        out[lo : lo + 64] = (a[lo : lo + 64, None, :] == b[None, :, :]).mean(2, dtype=np.float32)
    return out


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for rows whose work is in Python, where the size in bytes says little about the time."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def candidates(texts: DataFrame, length: int, near: float) -> DataFrame:
    """Edges (u, v) between texts (key, kid, sig, fine, open) of the same subtrie of that depth with near signatures, one of them open."""

    def path(t: Column) -> Column:
        at = t * (2 * DEPTH) + 1
        return F.struct(F.xxhash64(t, F.substring(F.col("sig"), at, F.lit(2 * length))).alias("trie"), F.substring(F.col("sig"), at + 2 * length, F.lit(2 * (DEPTH - length))).alias("rest"))

    paths = texts.where("sig IS NOT NULL").select("kid", "open", F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), path)).alias("p")).select("kid", "open", "p.trie", "p.rest")
    shared = paths.groupBy("trie").agg(F.count("*").alias("members"), F.max("open").alias("any")).where("members > 1 AND any")
    nodes = written(paths.join(shared.hint("merge"), "trie").select("trie", "rest", "members", "kid", "open"), "nodes")
    found = nodes.join(texts.select("kid", "key", "fine").hint("merge"), "kid")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begin in groups(batches, ["trie", "i", "j"]):
            n = len(rows)
            fine = np.frombuffer(b"".join(rows["fine"]), dtype=np.uint8).reshape(n, -1)
            group = np.zeros(n, dtype=np.int64)
            group[begin[1:]] = 1
            group = np.cumsum(group)
            keys, rest, is_open = rows["key"].to_numpy(dtype=object), rows["rest"].to_numpy(), rows["open"].to_numpy(dtype=bool)
            # the chain of neighbours in the order of the trie
            tied = (group[1:] == group[:-1]) & ((fine[1:] == fine[:-1]).mean(1, dtype=np.float32) >= near)
            segment = np.concatenate(([0], np.cumsum(~tied)))
            first = np.searchsorted(segment, segment)
            at = np.nonzero(first != np.arange(n))[0]
            edges: dict[str, list] = {"u": list(keys[at]), "v": list(keys[first[at]])}
            ends = np.append(begin[1:], n)
            for lo, hi in zip(begin[segment[begin] != segment[ends - 1]], ends[segment[begin] != segment[ends - 1]], strict=True):
                _, one, part, times = np.unique(np.array([f"{s}:{r.hex()}" for s, r in zip(segment[lo:hi], rest[lo:hi], strict=True)]), return_index=True, return_inverse=True, return_counts=True)
                speaks = np.zeros(hi - lo, dtype=bool)
                speaks[one[np.bincount(part, is_open[lo:hi]) > 0]] = True
                short = np.nonzero(((times[part] <= ENOUGH) & is_open[lo:hi]) | speaks)[0]
                if not len(short):
                    continue
                matrix = np.zeros((hi - lo, hi - lo), dtype=bool)
                matrix[short] = alike(fine[lo + short], fine[lo:hi]) >= near
                root = roots(matrix | matrix.T)
                at = np.nonzero(root != np.arange(hi - lo))[0]
                edges["u"].extend(keys[lo + at])
                edges["v"].extend(keys[lo + root[at]])
            yield pd.DataFrame(edges, dtype=object)

    pairs = paired(found, "trie", F.ceil(F.col("members") / NODE_BLOCK), "key", ["rest", "key"], tasks_for(texts.sparkSession, nodes.count(), 100_000))
    return pairs.select("trie", "i", "j", "rest", "key", "fine", "open").mapInPandas(compare, "u string, v string")


def recall(texts: DataFrame, family: DataFrame, threshold: float) -> float:
    """Of the pairs of SAMPLE texts (those with the smallest hashes) and any text whose signatures reach the threshold, the share that is in one family."""
    at = texts.where("sig IS NOT NULL").select("key", "fine").join(family.hint("merge"), "key", "left")
    few = at.orderBy(F.xxhash64(F.lit(SEED), "key"), "key").limit(SAMPLE).collect()  # SAMPLE rows
    if not few:
        return 1.0
    mine = np.frombuffer(b"".join(bytes(r["fine"]) for r in few), dtype=np.uint8).reshape(len(few), -1)
    names, families = np.array([r["key"] for r in few]), np.array([r["family"] or "" for r in few])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                fine = np.frombuffer(b"".join(b["fine"]), dtype=np.uint8).reshape(len(b), -1)
                close = (alike(mine, fine) >= threshold) & (names[:, None] != b["key"].to_numpy().astype(str)[None, :])
                kept = close & (families[:, None] == b["family"].fillna("").to_numpy().astype(str)[None, :]) & (families != "")[:, None]
                yield pd.DataFrame({"near": [int(close.sum())], "kept": [int(kept.sum())]})

    near, kept = at.mapInPandas(count, "near long, kept long").agg(F.sum("near"), F.sum("kept")).first()
    return kept / near if near else 1.0


def families(texts: DataFrame, threshold: float, target: float) -> tuple[DataFrame, int]:
    """(key, family) of the texts that have a candidate, and the shortest prefix that was used."""
    length, edges, tried = first_length(threshold, target), None, 0
    texts = texts.withColumn("open", F.lit(True))
    while True:
        found = written(candidates(texts, length, threshold - MARGIN), "candidates")
        edges = found if edges is None else edges.unionByName(found)
        family = written(components(edges).select(F.col("node").alias("key"), F.col("root").alias("family")), "families")
        reached = recall(texts, family, threshold)
        if reached < RECALL and length == 1:
            warnings.warn(f"near copies: {reached:.3f} of the sampled pairs are in one family, {RECALL} were wanted", stacklevel=2)
        if reached >= RECALL or length == 1:
            return family, length
        length, tried = length - 1, tried + 1
        if tried > 1:
            texts = texts.withColumn("open", F.lit(True))
            continue
        texts = texts.drop("open").join(family.select("key", F.lit(False).alias("open")).hint("merge"), "key", "left").withColumn("open", F.coalesce("open", F.lit(True)))


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
        return out
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    times = np.bincount(column, minlength=len(values))
    often = times > 1  # a shingle of one text is in no intersection
    place = np.cumsum(often) - 1
    keep = often[column]
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 4096
    for lo in range(0, int(often.sum()), step):
        a, b = np.searchsorted(column, (lo, lo + step))
        m = np.zeros((n, step), dtype=np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += (m @ m.T).astype(np.int64)
    out[np.arange(n), np.arange(n)] = [len(s) for s in sets]
    return out


def verified(members: DataFrame, threshold: float, tasks: int) -> DataFrame:
    """(key, root, links) of members (key, family, blocks, text): exact links within each pair of blocks, each counted once."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, begin in groups(batches, ["family", "i", "j"]):
            for lo, hi in zip(begin, [*begin[1:], len(rows)], strict=True):
                g = rows.iloc[lo:hi]
                sets = list(shingle_sets(list(g["text"])))  # texts are smaller on the way than their sets
                size = np.array([len(s) for s in sets])
                both = overlap(sets)
                own, i, j = g["own"].to_numpy(), int(g["i"].iloc[0]), int(g["j"].iloc[0])
                same = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                if i != j:
                    same &= own[:, None] != own[None, :]  # pairs within a block are counted in the group of that block
                np.fill_diagonal(same, False)
                if same.any():
                    keys, linked = g["key"].to_numpy(dtype=object), same.any(1)
                    yield pd.DataFrame({"key": keys[linked], "root": keys[roots(same)][linked], "links": same.sum(1)[linked]})

    return paired(members, "family", F.col("blocks"), "key", ["key"], tasks).select("family", "i", "j", "own", "key", "text").mapInPandas(compare, "key string, root string, links long")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row for each distinct text: (key, first_id, same, copies, class_key, class_id, links).

    first_id is the smallest id with that text and same the number of rows with both, class_id the
    smallest of the class, copies the number of rows with the text, links the number of other
    texts that are similar enough.
    """
    d = docs.select(F.col(id_col).alias("id"), whole(F.col(text_col)).alias("text"))
    each = signed(d).groupBy("key", "id").agg(F.count("*").alias("same"), F.first("bytes").alias("bytes"), F.first("sig").alias("sig"), F.first("fine").alias("fine"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "same"))
    texts = each.groupBy("key").agg(least.alias("f"), F.sum("same").alias("copies"), F.first("bytes").alias("bytes"), F.first("sig").alias("sig"), F.first("fine").alias("fine"))
    texts = written(texts.select("key", short(F.col("key")).alias("kid"), F.col("f.id").alias("first_id"), F.col("f.same").alias("same"), "copies", "bytes", "sig", "fine"), "texts")
    family, _ = families(texts, threshold, target)
    family = family.join(texts.select("key", "first_id", "bytes").hint("merge"), "key")
    sizes = family.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("blocks"))
    family = written(family.join(sizes.hint("merge"), "family").select("key", "first_id", "family", "blocks"), "members")
    words = marks(family.select(short(F.col("key")).alias("h")), MAP_BITS)
    source = marked(d.withColumn("key", text_key(F.col("text"))), short(F.col("key")), words, MAP_BITS, "maybe").where("maybe").drop("maybe")
    rows = source.join(family.hint("merge"), "key").where(F.col("id").eqNullSafe(F.col("first_id"))).dropDuplicates(["key"])
    found = written(verified(rows.select("key", "family", "blocks", "text"), threshold, tasks_for(docs.sparkSession, family.count(), 5_000)), "links")
    counted = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("key").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("key"), F.col("root").alias("class_key"))
    linked = counted.join(classes.hint("merge"), "key", "left")
    out = texts.select("key", "first_id", "same", "copies").join(linked.hint("merge"), "key", "left")
    out = written(out.withColumns({"links": F.coalesce("links", F.lit(0).cast("long")), "class_key": F.coalesce("class_key", "key")}), "classes")
    first = out.groupBy("class_key").agg(F.min("first_id").alias("class_id"))
    return out.join(first.hint("merge"), "class_key").select("key", "first_id", "same", "copies", "class_key", "class_id", "links")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which no earlier one is of the same class: those with the smallest id.

    A repeated row (same id and text) stays once; of a class whose ids are all null one row stays.
    """
    k, t, m, y = fresh(docs, "jaccard_key", "jaccard_touched", "jaccard_match", "jaccard_maybe")
    classes = written(join(docs, id_col, text_col), "kept")
    # of a class, the text with the smallest id stays; equal ids: the smaller key
    best = classes.groupBy("class_key").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key")).alias("b"))
    touched = classes.join(best.hint("merge"), "class_key").where((F.col("copies") > 1) | (F.col("key") != F.col("b.key")))
    touched = written(touched.select(F.col("key").alias(m), F.struct("first_id", "same", (F.col("key") == F.col("b.key")).alias("stays")).alias(t)), "touched")
    words = marks(touched.select(short(F.col(m)).alias("h")), MAP_BITS)
    named = marked(docs.withColumn(k, text_key(F.col(text_col))), short(F.col(k)), words, MAP_BITS, y)
    clear, rest = named.where(~F.col(y)), named.where(F.col(y))
    joined = rest.join(touched.hint("merge"), F.col(k) == F.col(m), "left")
    first = F.col(f"{t}.stays") & F.col(id_col).eqNullSafe(F.col(f"{t}.first_id"))
    kept = joined.where(F.col(m).isNull() | (first & (F.col(f"{t}.same") == 1)))
    once = joined.where(first & (F.col(f"{t}.same") > 1)).dropDuplicates([k])
    return clear.select(*docs.columns).unionByName(kept.select(*docs.columns)).unionByName(once.select(*docs.columns))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class, its links to different texts, and the other rows with its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(join(docs).hint("merge"), "key")
    return rows.select("doc_id", "class_id", F.col("links").alias("n_links"), (F.col("copies") - 1).alias("n_copies"))
