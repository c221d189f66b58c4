"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask is a window of tokens of which some positions are ignored. The tokens at the other
positions are hashed, for every window of the benchmark and of the documents; a substitution at
an ignored position leaves the hash as it is, and several masks make it likely that one of them
fits. Windows with equal hashes are joined; around each hit the two token sequences are compared
along its diagonal, and the best run (match 1, substitution -3) decides: a document overlaps an
item if the run has MIN_TOKENS tokens (or the whole of a shorter item) and SHARE of them agree.

Windows of one text with the same hash that follow each other closely, as in text that repeats itself,
are joined as one span, so a join gives no product of their numbers; the diagonals of a text and an
item, no more than both have tokens, are brought together and compared in one row.

Tokens are runs of letters and digits in lower case. Before the join, windows of documents pass two
bitmaps of bounded size made from the benchmark: one of adjacent token pairs, with which every mask
begins, and one of mask hashes. They let nothing be lost; a larger benchmark only lets more through.

An item of fewer tokens than the shortest mask has no window: it is joined exactly, by the hash of
all its tokens. An item too short for the masks with gaps has masks of its own length, each of which
ignores one position: those at which the best run crosses a substitution (see GAPPED; nearer to an
end the run stops there, and what is left is shorter than the item). An item without tokens matches
nothing.

Null texts count as empty. Rows with the same text share one decision. An empty benchmark or no
documents: nothing overlaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, fresh, has, let, table, text_key, whole, written

# 1 keeps a token, 0 ignores it; each begins with two kept tokens.
MASKS = ("1101101101", "1110010111", "1101010011", "1111111")
SHORTEST, LONGEST = min(map(len, MASKS)), max(map(len, MASKS))
MIN_TOKENS, SHARE, LOSS = 13, 0.8, 3
#: (tokens, position): a run of so many tokens outweighs the loss at this position, as more than LOSS tokens agree on both sides of it.
GAPPED = [(n, i) for n in range(SHORTEST, LONGEST) for i in range(LOSS + 1, n - 1 - LOSS)]
#: Bits of the maps: FILL for each hash of the benchmark, MOST_BITS at most.
FILL, MOST_BITS = 256, 1 << 23
#: Windows with one hash that are no farther apart are a span.
GAP = 16


def token_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def pair(h: Column, j: Column) -> Column:
    return F.xxhash64(F.get(h, j), F.get(h, j + 1))


def seeds(h: Column, j: Column) -> Column:
    """array<struct<j,hash>>: the hash under each mask of the window at j that lies within h."""
    found = []
    for i, mask in enumerate(MASKS):
        kept = [F.get(h, j + o) for o, c in enumerate(mask) if c == "1"]
        found.append(F.when(j + len(mask) <= F.size(h), F.struct(j.alias("j"), F.xxhash64(F.lit(i), *kept).alias("hash"))))
    return F.array_compact(F.array(*found))


def grouped(found: Column) -> Column:
    """array<struct<hash,j,to>>: of an array of structs (j, hash), the spans of windows with one hash that are at most GAP apart."""
    apart = lambda a, b: a["hash"].isNull() | b["hash"].isNull() | (a["hash"] != b["hash"]) | (b["j"] - a["j"] > GAP)

    def build(x: Column) -> Column:
        last = F.filter(x, lambda e, i: apart(e, F.get(x, i + 1)))
        return let(last, lambda ends: F.transform(F.filter(x, lambda e, i: apart(F.get(x, i - 1), e)), lambda e, i: F.struct(e["hash"].alias("hash"), e["j"].alias("j"), F.get(ends, i)["j"].alias("to"))))

    return let(F.array_sort(F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), x["j"].alias("j")))), build)


def windows(h: Column) -> Column:
    return F.when(F.size(h) >= SHORTEST, F.sequence(F.lit(0), F.size(h) - SHORTEST)).otherwise(F.array().cast("array<int>"))


def short_hash(h: Column, j: Column, n: Column) -> Column:
    """The hash of the n tokens from j on, for items without a window."""
    return F.xxhash64(F.lit(-1), n, F.slice(h, j + 1, n))


def short_runs(h: Column, lengths: Column) -> Column:
    """array<struct<j,hash>> of the runs in h of as many tokens as a short item has."""

    def of(n: Column) -> Column:
        starts = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda j: F.struct(j.alias("j"), short_hash(h, j, n).alias("hash")))

    return F.flatten(F.transform(F.filter(lengths, lambda n: n < SHORTEST), of))


def gapped_hash(h: Column, j: Column, n: int, i: int) -> Column:
    """The hash of the n tokens from j on without the i-th."""
    return F.xxhash64(F.lit(-2), F.lit(n), F.lit(i), *[F.get(h, j + o) for o in range(n) if o != i])


def gapped_runs(h: Column, lengths: Column) -> Column:
    """array<struct<j,hash>> of the runs in h, one position ignored, that are as long as an item with such masks."""
    none = F.array().cast("array<struct<j:int,hash:bigint>>")

    def of(n: int, i: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - n)
        return F.when(F.array_contains(lengths, n) & (F.size(h) >= n), F.transform(starts, lambda j: F.struct(j.alias("j"), gapped_hash(h, j, n, i).alias("hash")))).otherwise(none)

    return F.flatten(F.array(none, *[of(n, i) for n, i in GAPPED]))


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, ht): distinct texts with their token hashes; the smallest id of a text stands for it."""
    items = benchmark.select(F.col(id_col).alias("item_id"), whole(F.col(text_col)).alias("text")).groupBy("text").agg(F.min("item_id").alias("item_id"))
    return items.select(text_key(F.col("text")).alias("item"), "item_id", token_hashes(F.col("text")).alias("ht"))


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(key, item_id, start, tokens, matched) for each text (by its key) and benchmark item that overlap; start in tokens of the document."""
    items = written(benchmark_items(benchmark, id_col, item_text_col), "items")
    spots = items.select("item", "ht", F.explode(windows(F.col("ht"))).alias("p"))
    test = items.select("item", F.explode(grouped(F.flatten(F.transform(windows(F.col("ht")), lambda p: seeds(F.col("ht"), p))))).alias("x")).select("item", F.col("x.j").alias("p"), F.col("x.to").alias("q"), "x.hash")
    short = items.where(F.size("ht").between(1, SHORTEST - 1))
    test = test.unionByName(short.select("item", F.lit(0).alias("p"), F.lit(0).alias("q"), short_hash(F.col("ht"), F.lit(0), F.size("ht")).alias("hash")))
    for n, i in GAPPED:
        test = test.unionByName(items.where(F.size("ht") == n).select("item", F.lit(0).alias("p"), F.lit(0).alias("q"), gapped_hash(F.col("ht"), F.lit(0), n, i).alias("hash")))
    test = written(test, "seeds")
    lengths = items.where(F.size("ht").between(1, LONGEST - 1)).agg(F.sort_array(F.collect_set(F.size("ht"))).alias("a")).scalar()  # LONGEST - 1 numbers at most
    bits = min(MOST_BITS, 1 << max(14, (FILL * test.count()).bit_length()))
    pairs = bitmap(spots.select(pair(F.col("ht"), F.col("p")).alias("h")), bits)
    known = bitmap(test.select(F.col("hash").alias("h")), bits)
    again = bitmap(test.select(F.xxhash64("hash").alias("h")), bits)

    def scan(h: Column, pairs: Column, known: Column, again: Column, lengths: Column) -> Column:
        begun = F.filter(windows(h), lambda j: has(pairs, bits, pair(h, j)))
        found = F.concat(F.flatten(F.transform(begun, lambda j: seeds(h, j))), short_runs(h, lengths), gapped_runs(h, lengths))
        hit = F.filter(found, lambda x: has(known, bits, x["hash"]) & has(again, bits, F.xxhash64(x["hash"])))
        return F.struct(h.alias("h"), hit.alias("hits"))

    # each scalar is a column that is used once, so that it stays a constant of the plan
    scanned = docs.select(whole(F.col(text_col)).alias("text")).withColumns({"pairs": pairs, "known": known, "again": again, "lengths": lengths})
    x = let(F.col("pairs"), lambda p: let(F.col("known"), lambda k: let(F.col("again"), lambda a: let(F.col("lengths"), lambda n: let(token_hashes(F.col("text")), lambda h: scan(h, p, k, a, n))))))
    scanned = scanned.select("text", F.explode(F.filter(F.array(x), lambda x: F.size(x["hits"]) > 0)).alias("x"))
    scanned = scanned.select(text_key(F.col("text")).alias("key"), "x").groupBy("key").agg(F.first("x").alias("x"))
    scanned = written(scanned.select("key", "x.h", "x.hits"), "scanned")

    # a common hash has few rows of the benchmark and many of documents: Spark splits such a side of a merge join
    mine = scanned.select("key", F.explode(grouped(F.col("hits"))).alias("x")).select("key", "x.hash", "x.j", "x.to")
    hits = mine.join(test.hint("merge"), "hash").select("key", "item", F.struct((F.col("j") - F.col("q")).alias("low"), (F.col("to") - F.col("p")).alias("high")).alias("d"))
    pairs = hits.groupBy("key", "item").agg(F.collect_set("d").alias("d"))
    both = pairs.join(items, "item").join(scanned.select("key", "h"), "key")

    def run(h: Column, ht: Column, d: Column) -> Column:
        return let(best_run(h, ht, d), lambda r: F.struct(r["tokens"].alias("tokens"), r["matched"].alias("matched"), (-(r["start"] + d)).alias("start")))

    enough = lambda r: (r["tokens"] >= F.least(F.lit(MIN_TOKENS), F.size("ht"))) & (r["matched"] >= SHARE * r["tokens"])
    diagonals = F.array_distinct(F.flatten(F.transform("d", lambda x: F.sequence(x["low"], x["high"]))))
    found = both.select("key", "item_id", F.array_max(F.filter(F.transform(diagonals, lambda d: run(F.col("h"), F.col("ht"), d)), enough)).alias("r")).where("r IS NOT NULL")
    return found.select("key", "item_id", (-F.col("r.start")).alias("start"), F.col("r.tokens").alias("tokens"), F.col("r.matched").alias("matched"))


def best_run(h: Column, ht: Column, diagonal: Column) -> Column:
    """struct<start,tokens,matched>: the run of the item along the diagonal with the largest score."""
    fields = "struct<at:int,sum:int,from:int,hit:int,best:int,start:int,tokens:int,matched:int>"
    zero = F.from_json(F.lit('{"at":0,"sum":0,"from":0,"hit":0,"best":0,"start":0,"tokens":0,"matched":0}'), fields)

    def step(a: Column, t: Column) -> Column:
        place = a["at"] + diagonal
        same = F.when((place >= 0) & (place < F.size(h)), F.get(h, place) == t).otherwise(False)
        gain = F.when(same, 1).otherwise(-LOSS)
        carry = a["sum"] > 0
        total = F.when(carry, a["sum"]).otherwise(0) + gain
        begin = F.when(carry, a["from"]).otherwise(a["at"])
        hit = F.when(carry, a["hit"]).otherwise(0) + same.cast("int")
        better = total > a["best"]
        return F.struct(
            (a["at"] + 1).alias("at"), total.alias("sum"), begin.alias("from"), hit.alias("hit"), F.greatest(total, a["best"]).alias("best"),
            F.when(better, begin).otherwise(a["start"]).alias("start"), F.when(better, a["at"] + 1 - begin).otherwise(a["tokens"]).alias("tokens"), F.when(better, hit).otherwise(a["matched"]).alias("matched"),
        )

    return F.aggregate(ht, zero, step, lambda a: F.struct(a["start"].alias("start"), a["tokens"].alias("tokens"), a["matched"].alias("matched")))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that overlap no item; all columns, and repeated rows, stay."""
    (k,) = fresh(docs, "leak_key")
    leaks = written(overlaps(docs, benchmark, text_col).select(F.col("key").alias("leak")).distinct(), "leaks")
    named = docs.withColumn(k, text_key(F.col(text_col)))
    return named.join(leaks, named[k] == leaks["leak"], "left_anti").select(*docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: whether it overlaps a benchmark item, which, and the longest run in tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    each = written(found.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("tokens").alias("longest")), "leaks")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(each, "key", "left")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast(each.schema["item_ids"].dataType)).alias("item_ids"), F.coalesce("longest", F.lit(0)).alias("longest"))
