"""Frequent itemsets, association rules and what is made of them. Baskets are rows (order_id, item), distinct."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-9


def with_empty(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """(order_id, items): each order's sorted items; an order without lines has none."""
    baskets = lines.groupBy("order_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return orders.select("order_id").distinct().join(baskets, "order_id", "left").select("order_id", F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def frequency(lines: DataFrame, total: int) -> DataFrame:
    """(item, orders, share) over all orders."""
    return lines.groupBy("item").agg(F.count("*").alias("orders")).withColumn("share", F.col("orders") / F.lit(total))


def equal_baskets(lines: DataFrame) -> DataFrame:
    """(all, orders, first): the distinct baskets as sorted arrays, the number of orders that have each, and the smallest of them."""
    each = lines.groupBy("order_id").agg(F.array_sort(F.collect_list("item")).alias("all"))
    return each.groupBy("all").agg(F.count("*").alias("orders"), F.min("order_id").alias("first"))


def itemsets(lines: DataFrame, total: int, support: float, longest: int = 3, equal: DataFrame | None = None) -> DataFrame:
    """(items, cnt, support) of all itemsets in at least support x total orders, level by level. equal: equal_baskets of lines, if they are kept.

    Orders are brought together once, as sorted arrays, and equal ones are one row that counts for all
    of them. An occurrence of a set is a row with the rest of its basket, the items behind the set's last; a
    level extends each occurrence of a frequent set by every item of its rest, if all smaller subsets are frequent too. So a level shuffles only its
    counts, summed up before, and looks sets up in the level before by a semi-join on their arrays,
    which Spark broadcasts where that level is small.
    """
    least = support * total
    equal = equal_baskets(lines).persist() if equal is None else equal
    after = lambda column, i: F.slice(column, i + 2, F.greatest(F.lit(1), F.size(column)))
    held = equal.select("orders", "all", F.posexplode("all").alias("i", "item")).select("orders", F.array("item").alias("items"), after("all", F.col("i")).alias("rest"))
    levels = []
    for size in range(1, longest + 1):
        counts = held.groupBy("items").agg(F.sum("orders").alias("cnt")).where(F.col("cnt") >= least).persist()
        levels.append(counts)
        if size == longest or counts.isEmpty():
            break
        frequent = held.join(counts.select("items"), "items", "left_semi")
        grown = frequent.select("orders", "items", "rest", F.posexplode("rest").alias("i", "item"))
        held = grown.select("orders", F.concat("items", F.array("item")).alias("items"), after("rest", F.col("i")).alias("rest"))
        for i in range(size):  # downward closure: the subsets with the new item
            part = F.concat(F.slice("items", 1, i), F.slice("items", i + 2, size))
            held = held.withColumn("part", part).join(counts.select(F.col("items").alias("part")), "part", "left_semi").drop("part")
    return reduce(DataFrame.unionByName, levels).withColumn("support", F.col("cnt") / F.lit(total))


def fp_itemsets(baskets: DataFrame, total: int, support: float, longest: int = 3) -> DataFrame:
    """The same by Spark's FP-Growth; empty baskets stay in the denominator."""
    model = FPGrowth(itemsCol="items", minSupport=support).fit(baskets)
    found = model.freqItemsets.where(F.size("items") <= longest)
    return found.select(F.array_sort("items").alias("items"), F.col("freq").alias("cnt"), (F.col("freq") / F.lit(total)).alias("support"))


def tid_itemsets(lines: DataFrame, total: int, support: float, longest: int = 3, blocks: int = 64, equal: DataFrame | None = None) -> DataFrame:
    """The same by intersecting lists of orders, kept in blocks of orders so that no list holds all of a frequent item's.

    The first of the orders with equal baskets stands in the lists for all of them; the orders of a block stand
    for equally many, so a list counts its length times that number. equal: equal_baskets of lines, if they are kept.
    """
    least = support * total
    equal = equal_baskets(lines) if equal is None else equal
    block = F.struct(F.pmod(F.xxhash64("first"), F.lit(blocks)).alias("part"), "orders")
    own = equal.select(block.alias("block"), "first", F.explode("all").alias("item")).groupBy("block", F.array("item").alias("items")).agg(F.collect_list("first").alias("tids"))
    levels = []
    now = own
    for size in range(1, longest + 1):
        counts = now.groupBy("items").agg(F.sum(F.size("tids") * F.col("block.orders")).alias("cnt")).where(F.col("cnt") >= least)
        levels.append(counts)
        if size == longest:
            break
        kept = now.join(counts.select("items"), "items", "left_semi")
        side = kept.select("block", F.slice("items", 1, size - 1).alias("stem"), F.element_at("items", -1).alias("last"), "tids")
        both = side.alias("a").join(side.alias("b"), ["block", "stem"]).where("a.last < b.last")
        now = both.select("block", F.concat("stem", F.array("a.last", "b.last")).alias("items"), F.array_intersect("a.tids", "b.tids").alias("tids")).where(F.size("tids") > 0)
    return reduce(DataFrame.unionByName, levels).withColumn("support", F.col("cnt") / F.lit(total))


#: Miners by name, for callers that choose one.
ALGORITHMS = {"apriori": itemsets, "fpgrowth": fp_itemsets, "tidlists": tid_itemsets}


def agreement(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: keys only in a, only in b, in both, and in both with different values."""
    j = a.select(*keys, F.col(value).alias("va")).join(b.select(*keys, F.col(value).alias("vb")), keys, "full_outer")
    return j.agg(F.count_if(F.col("vb").isNull()).alias("only_left"), F.count_if(F.col("va").isNull()).alias("only_right"), F.count_if(F.col("va").isNotNull() & F.col("vb").isNotNull()).alias("common"), F.count_if(F.abs(F.col("va") - F.col("vb")) > tolerance).alias("different"))


def rules(found: DataFrame, confidence: float, lift: float) -> DataFrame:
    """All splits of each itemset into antecedent and consequent that pass the gates, ranked.

    The splits are the bit masks of the items; both sides are looked up by equi-joins on their
    sorted arrays.
    """
    n = F.size("items")
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), n).cast("int") - 2)
    split = found.where(n >= 2).select("items", "support", F.explode(masks).alias("mask"))
    side = lambda bit: F.filter("items", lambda x, i: F.floor(F.col("mask") / F.pow(F.lit(2), i)) % 2 == bit)
    split = split.select("support", side(1).alias("antecedent"), side(0).alias("consequent"))
    marg = lambda name: found.select(F.col("items").alias(name), F.col("support").alias(f"{name}_support"))
    out = split.join(marg("antecedent"), "antecedent").join(marg("consequent"), "consequent")
    a, c, s = F.col("antecedent_support"), F.col("consequent_support"), F.col("support")
    out = out.withColumns({"confidence": s / a, "lift": s / (a * c), "leverage": s - a * c})
    out = out.withColumn("conviction", (1 - c) / F.greatest(1 - F.col("confidence"), F.lit(EPSILON))).where((F.col("confidence") >= confidence) & (F.col("lift") >= lift))
    order = Window.orderBy(F.desc(F.round("lift", 9)), F.desc(F.round("confidence", 9)), "antecedent", "consequent")
    return out.withColumn("rank", F.row_number().over(order)).select("rank", "antecedent", "consequent", "support", "confidence", "lift", "leverage", "conviction", "antecedent_support", "consequent_support")


def fired(lines: DataFrame, ranked: DataFrame) -> DataFrame:
    """(order_id, rank): rules whose whole antecedent is in the basket, by an equi-join on its items."""
    parts = ranked.select("rank", F.size("antecedent").alias("need"), F.explode("antecedent").alias("item"))
    return lines.join(parts, "item").groupBy("order_id", "rank").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need").select("order_id", "rank")


def recommend(lines: DataFrame, ranked: DataFrame, top: int = 6, support: int = 3) -> DataFrame:
    """(order_id, place, item, score, rank, supporting): the best items that a basket lacks.

    A rule scores lift x confidence; each candidate has its best rule (equal scores: the first
    by rank) and the ranks of its supporting rules.
    """
    scored = ranked.select("rank", F.round(F.col("lift") * F.col("confidence"), 9).alias("score"), F.explode("consequent").alias("item"))
    hits = fired(lines, ranked).join(scored, "rank").join(lines, ["order_id", "item"], "left_anti")
    each = hits.groupBy("order_id", "item").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank")).alias("b"), F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "rank"))), 1, support).alias("all"))
    order = Window.partitionBy("order_id").orderBy("b.s", "item")
    out = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return out.select("order_id", "place", "item", (-F.col("b.s")).alias("score"), F.col("b.rank").alias("rank"), F.transform("all", lambda x: x["rank"]).alias("supporting"))


def graph(ranked: DataFrame, top: int = 50) -> tuple[DataFrame, DataFrame]:
    """Edges of rules between two single items (the strongest of each pair, with their number), and their end points."""
    pairs = ranked.where((F.size("antecedent") == 1) & (F.size("consequent") == 1)).orderBy("rank").limit(top)
    edges = pairs.select(F.get("antecedent", F.lit(0)).alias("source"), F.get("consequent", F.lit(0)).alias("target"), "lift", "confidence", "rank")
    edges = edges.groupBy("source", "target").agg(F.max_by("lift", -F.col("rank")).alias("lift"), F.max_by("confidence", -F.col("rank")).alias("confidence"), F.count("*").alias("rule_count"))
    return edges, edges.select(F.col("source").alias("item")).union(edges.select(F.col("target").alias("item"))).distinct()


def neighbourhood(edges: DataFrame, node: int, limit: int) -> DataFrame:
    """The strongest edges that touch a node."""
    return edges.where((F.col("source") == node) | (F.col("target") == node)).orderBy(F.desc("lift"), "source", "target").limit(limit)


def labelled(ranked: DataFrame, names: DataFrame) -> DataFrame:
    """(rank, text): rules as "A + B -> C" through names (item, name); an unknown item stays a number."""
    def side(column: str) -> DataFrame:
        parts = ranked.select("rank", F.posexplode(column).alias("at", "item")).join(names, "item", "left")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("name", F.col("item").cast("string")).alias("name")))), lambda x: x["name"]), " + ")
        return parts.groupBy("rank").agg(text.alias(column))
    return side("antecedent").join(side("consequent"), "rank").select("rank", F.concat("antecedent", F.lit(" -> "), "consequent").alias("text"))


def presets(ranked: DataFrame, limit: int = 4) -> DataFrame:
    """Distinct antecedents of the best rules, those of several items first."""
    best = ranked.groupBy("antecedent").agg(F.min("rank").alias("rank"))
    return best.orderBy(F.desc(F.size("antecedent") > 1), "rank").limit(limit)


def gate(trials: DataFrame, objective: str, floor: Column, step: float) -> DataFrame:
    """trials with accepted: a trial in order of trial is kept if it beats the last kept one by step and passes the floor; ties keep the earlier.

    The fold is over a table of trials, a few rows by nature.
    """
    rows = F.array_sort(F.collect_list(F.struct("trial", F.col(objective).alias("value"), floor.alias("ok"))))
    start = F.struct(F.lit(None).cast("double").alias("best"), F.array().cast("array<int>").alias("kept"))

    def fold(a: Column, x: Column) -> Column:
        better = x["ok"] & x["value"].isNotNull() & (a["best"].isNull() | (x["value"] > a["best"] + step))
        return F.struct(F.when(better, x["value"]).otherwise(a["best"]).alias("best"), F.when(better, F.concat(a["kept"], F.array(x["trial"]))).otherwise(a["kept"]).alias("kept"))

    kept = trials.agg(F.aggregate(rows, start, fold, lambda a: a["kept"]).alias("kept"))
    return trials.crossJoin(F.broadcast(kept)).withColumn("accepted", F.array_contains("kept", F.col("trial"))).drop("kept")  # one row


def basket_values(lines: DataFrame, recommended: DataFrame, prices: DataFrame, top: int = 3) -> DataFrame:
    """(order_id, basket_value, add_on_value): what a basket with recommendations is worth, and what its first top recommendations would add. prices: (item, price)."""
    worth = lambda df, name: df.join(prices, "item").groupBy("order_id").agg(F.sum("price").alias(name))
    some = recommended.select("order_id").distinct()
    return worth(lines.join(some, "order_id", "left_semi"), "basket_value").join(worth(recommended.where(F.col("place") <= top), "add_on_value"), "order_id", "left")
