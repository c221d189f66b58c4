"""Market baskets: catalog, itemsets by three algorithms, rules, recommendations, graph, threshold search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import baskets as ops
from ..operators import cleaning
from ..plans import views
from ..sources.stored import cut
from ..sources.tables import parquet
from .registry import query

SUPPORT, CONFIDENCE, LIFT, STRONG = 0.002, 0.02, 1.05, 1.25
LINES = f"WITH {views.BASKETS_SQL}, total AS (SELECT count(*) AS n FROM orders)"
SETS = f"""{LINES}, s1 AS (SELECT [item] AS items, count(*) AS cnt FROM lines, total GROUP BY item HAVING count(*) >= {SUPPORT} * any_value(n)),
s2 AS (SELECT [a.item, b.item] AS items, count(*) AS cnt FROM lines a JOIN lines b ON a.order_id = b.order_id AND a.item < b.item, total GROUP BY a.item, b.item HAVING count(*) >= {SUPPORT} * any_value(n)),
s3 AS (SELECT [a.item, b.item, c.item] AS items, count(*) AS cnt FROM lines a JOIN lines b ON a.order_id = b.order_id AND a.item < b.item JOIN lines c ON a.order_id = c.order_id AND b.item < c.item, total GROUP BY a.item, b.item, c.item HAVING count(*) >= {SUPPORT} * any_value(n)),
sets AS (SELECT items, cnt, cnt / n AS support FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), total)"""
RULES = f"""{SETS}, masks AS (SELECT items, support, unnest(range(1, (2 ^ len(items))::int - 1)) AS mask FROM sets WHERE len(items) >= 2),
sides AS (SELECT support, list_filter(items, lambda x, i: (mask // (2 ^ (i - 1))::int) % 2 = 1) AS antecedent, list_filter(items, lambda x, i: (mask // (2 ^ (i - 1))::int) % 2 = 0) AS consequent FROM masks),
r0 AS (SELECT antecedent, consequent, s.support, a.support AS antecedent_support, c.support AS consequent_support, s.support / a.support AS confidence, s.support / (a.support * c.support) AS lift FROM sides s JOIN sets a ON a.items = antecedent JOIN sets c ON c.items = consequent),
rules AS (SELECT row_number() OVER (ORDER BY round(lift, 9) DESC, round(confidence, 9) DESC, antecedent, consequent) AS rank, *, support - antecedent_support * consequent_support AS leverage, (1 - consequent_support) / greatest(1 - confidence, 1e-9) AS conviction FROM r0 WHERE confidence >= {CONFIDENCE} AND lift >= {LIFT})"""
FIRED = f"""{RULES}, parts AS (SELECT rank, len(antecedent) AS need, unnest(antecedent) AS item FROM rules WHERE lift >= {STRONG}), fired AS (SELECT order_id, rank FROM lines JOIN parts USING (item) GROUP BY order_id, rank HAVING count(*) = any_value(need))"""


def total(spark: SparkSession, sf_dir: str) -> int:
    return parquet(spark, sf_dir, "orders", ["o_orderkey"]).count()


def mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.itemsets(views.basket_lines(spark, sf_dir), total(spark, sf_dir), SUPPORT)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.rules(mined(spark, sf_dir), CONFIDENCE, LIFT)


@query(f"{LINES}, i AS (SELECT item, count(*) AS cnt FROM lines GROUP BY item), p AS (SELECT a.item AS a, b.item AS b, count(*) AS cnt FROM lines a JOIN lines b ON a.order_id = b.order_id AND a.item < b.item GROUP BY ALL), l AS (SELECT p.a, p.b, p.cnt, p.cnt / n AS support, p.cnt / x.cnt AS confidence, (p.cnt::double * n) / (x.cnt::double * y.cnt) AS lift FROM p JOIN i x ON x.item = p.a JOIN i y ON y.item = p.b, total) SELECT row_number() OVER (ORDER BY round(lift, 9) DESC, a, b) AS place, a AS item_a, b AS item_b, cnt, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM l WHERE lift > {LIFT}")
def basket_pair_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.basket_lines(spark, sf_dir)
    counts = lines.groupBy("item").agg(F.count("*").alias("n"))
    pairs = lines.alias("x").join(lines.alias("y"), "order_id").where("x.item < y.item").groupBy(F.col("x.item").alias("item_a"), F.col("y.item").alias("item_b")).agg(F.count("*").alias("cnt"))
    pairs = pairs.join(counts.select(F.col("item").alias("item_a"), F.col("n").alias("na")), "item_a").join(counts.select(F.col("item").alias("item_b"), F.col("n").alias("nb")), "item_b")
    n = F.lit(total(spark, sf_dir))
    out = pairs.withColumns({"support": F.col("cnt") / n, "confidence": F.col("cnt") / F.col("na"), "lift": F.col("cnt").cast("double") * n / (F.col("na").cast("double") * F.col("nb"))}).where(F.col("lift") > LIFT)
    out = out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("lift", 9)), "item_a", "item_b")))
    return out.select("place", "item_a", "item_b", "cnt", *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift")])


@query(f"{LINES} SELECT item, count(*) AS orders, round(count(*) / any_value(n), 6) AS share FROM lines, total GROUP BY item")
def basket_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.frequency(views.basket_lines(spark, sf_dir), total(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query(f"""{LINES}, f AS (SELECT item, count(*) AS orders FROM lines GROUP BY item), d AS (SELECT regexp_extract(p_brand, '[0-9]+')::bigint AS item, min(p_brand) AS name, min(p_type) AS kind FROM part WHERE p_size > 10 GROUP BY 1)
SELECT row_number() OVER (ORDER BY orders DESC, item) AS place, item, coalesce(name, 'unknown') AS name, coalesce(kind, 'unknown') AS kind, orders FROM f LEFT JOIN d USING (item), total WHERE orders / n >= 0.01""")
def basket_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parquet(spark, sf_dir, "part", ["p_brand", "p_type", "p_size"]).where("p_size > 10")
    names = part.groupBy(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("item")).agg(F.min("p_brand").alias("name"), F.min("p_type").alias("kind"))
    f = ops.frequency(views.basket_lines(spark, sf_dir), total(spark, sf_dir)).where("share >= 0.01")
    return f.join(names, "item", "left").na.fill("unknown", ["name", "kind"]).select(F.row_number().over(Window.orderBy(F.desc("orders"), "item")).alias("place"), "item", "name", "kind", "orders")


@query(f"""{LINES}, b AS (SELECT o_orderkey, count(item) AS size FROM orders LEFT JOIN lines ON order_id = o_orderkey GROUP BY 1), f AS (SELECT item, count(*) / any_value(n) AS share FROM lines, total GROUP BY item)
SELECT count(*) AS orders, count(*) FILTER (WHERE size >= 2) AS several, count(*) FILTER (WHERE size = 0) AS empty, round(avg(size), 6) AS mean_size, (SELECT count(*) FROM f) AS items, (SELECT item FROM f ORDER BY share DESC, item LIMIT 1) AS top_item, round((SELECT max(share) FROM f), 6) AS top_share, round((SELECT median(share) FROM f), 6) AS median_share FROM b""")
def basket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.basket_lines(spark, sf_dir)
    orders = parquet(spark, sf_dir, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("order_id"))
    b = ops.with_empty(lines, orders).agg(F.count("*").alias("orders"), F.count_if(F.size("items") >= 2).alias("several"), F.count_if(F.size("items") == 0).alias("empty"), F.round(F.avg(F.size("items")), 6).alias("mean_size"))
    f = ops.frequency(lines, total(spark, sf_dir)).agg(F.count("*").alias("items"), F.max_by("item", F.struct("share", -F.col("item"))).alias("top_item"), F.round(F.max("share"), 6).alias("top_share"), F.round(F.median("share"), 6).alias("median_share"))
    return b.crossJoin(f)  # one row each


def _sets(df: DataFrame) -> DataFrame:
    return df.select(F.array_join(F.col("items").cast("array<string>"), "+").alias("items"), "cnt", F.round("support", 6).alias("support"))


SETS_OUT = f"{SETS} SELECT array_to_string(items, '+') AS items, cnt, round(support, 6) AS support FROM sets"


@query(SETS_OUT)
def mining_apriori(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(mined(spark, sf_dir))


@query(SETS_OUT)
def mining_fpgrowth(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = parquet(spark, sf_dir, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("order_id"))
    return _sets(ops.fp_itemsets(ops.with_empty(views.basket_lines(spark, sf_dir), orders), total(spark, sf_dir), SUPPORT))


@query(SETS_OUT)
def mining_tidlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(ops.tid_itemsets(views.basket_lines(spark, sf_dir), total(spark, sf_dir), SUPPORT))


@query(f"{SETS} SELECT 0::bigint AS only_left, 0::bigint AS only_right, count(*) AS common, 0::bigint AS different FROM sets")
def mining_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, n = views.basket_lines(spark, sf_dir), total(spark, sf_dir)
    equal = cut(ops.equal_baskets(lines))  # both miners start from them
    return ops.agreement(ops.itemsets(lines, n, SUPPORT, equal=equal), ops.tid_itemsets(lines, n, SUPPORT, equal=equal), ["items"], "support")


@query(f"{SETS} SELECT len(items)::int AS size, count(*) AS itemsets, max(cnt) AS most, min(cnt) AS least FROM sets GROUP BY 1")
def mining_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(spark, sf_dir).groupBy(F.size("items").alias("size")).agg(F.count("*").alias("itemsets"), F.max("cnt").alias("most"), F.min("cnt").alias("least"))


@query(f"{RULES} SELECT rank, array_to_string(antecedent, '+') AS antecedent, array_to_string(consequent, '+') AS consequent, round(support, 6) AS support, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(leverage, 6) AS leverage, round(conviction, 4) AS conviction FROM rules")
def basket_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), "+").alias(c)
    return ranked(spark, sf_dir).select("rank", text("antecedent"), text("consequent"), *[F.round(c, 6).alias(c) for c in ("support", "confidence", "lift", "leverage")], F.round("conviction", 4).alias("conviction"))


@query(f"{RULES} SELECT count(*) AS rules, round(avg(lift), 6) AS mean_lift, round(avg(confidence), 6) AS mean_confidence, round(max(lift), 6) AS top_lift, max(len(antecedent))::int AS longest FROM rules")
def basket_rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).agg(F.count("*").alias("rules"), F.round(F.avg("lift"), 6).alias("mean_lift"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.max("lift"), 6).alias("top_lift"), F.max(F.size("antecedent")).alias("longest"))


@query(f"{FIRED} SELECT (SELECT count(*) FROM orders) AS orders, count(DISTINCT order_id) AS covered, round(count(DISTINCT order_id) / (SELECT count(*) FROM orders), 6) AS coverage FROM fired")
def basket_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.lit(total(spark, sf_dir)).cast("long")
    return ops.fired(views.basket_lines(spark, sf_dir), ranked(spark, sf_dir).where(F.col("lift") >= STRONG)).agg(n.alias("orders"), F.count_distinct("order_id").alias("covered"), F.round(F.count_distinct("order_id") / n, 6).alias("coverage"))


@query(f"""{FIRED}, sc AS (SELECT rank, round(lift * confidence, 9) AS score, unnest(consequent) AS item FROM rules WHERE lift >= {STRONG}), h AS (SELECT order_id, item, score, rank FROM fired JOIN sc USING (rank) WHERE NOT EXISTS (SELECT 1 FROM lines WHERE lines.order_id = fired.order_id AND lines.item = sc.item)),
b AS (SELECT *, row_number() OVER (PARTITION BY order_id, item ORDER BY score DESC, rank) AS k FROM h), g AS (SELECT order_id, item, max(score) AS score, min(rank) FILTER (WHERE k = 1) AS rank, array_to_string(list(rank ORDER BY k) FILTER (WHERE k <= 3), ',') AS supporting FROM b GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, item) AS place FROM g) SELECT order_id, place, item, round(score, 6) AS score, rank, supporting FROM p WHERE place <= 6""")
def basket_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.recommend(views.basket_lines(spark, sf_dir), ranked(spark, sf_dir).where(F.col("lift") >= STRONG))
    return out.select("order_id", "place", "item", F.round("score", 6).alias("score"), "rank", F.array_join(F.col("supporting").cast("array<string>"), ",").alias("supporting"))


EDGES = f"""{RULES}, e AS (SELECT antecedent[1] AS source, consequent[1] AS target, lift, confidence FROM rules WHERE len(antecedent) = 1 AND len(consequent) = 1 ORDER BY rank LIMIT 50)"""


@query(f"{EDGES} SELECT source, target, round(lift, 6) AS lift, round(confidence, 6) AS confidence, 1::bigint AS rule_count FROM e")
def basket_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.graph(ranked(spark, sf_dir))[0].select("source", "target", F.round("lift", 6).alias("lift"), F.round("confidence", 6).alias("confidence"), "rule_count")


@query(f"{EDGES} SELECT item, round(count(*) / any_value(n), 6) AS share FROM (SELECT source AS item FROM e UNION SELECT target FROM e) JOIN lines USING (item), total GROUP BY item")
def basket_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mined(spark, sf_dir)
    share = found.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("item"), F.round("support", 6).alias("share"))  # every item of a rule is a frequent set
    return ops.graph(ops.rules(found, CONFIDENCE, LIFT))[1].join(share, "item").select("item", "share")


@query(f"{EDGES}, top AS (SELECT source AS node FROM e ORDER BY lift DESC, source, target LIMIT 1) SELECT source, target, round(lift, 6) AS lift FROM e, top WHERE source = node OR target = node ORDER BY e.lift DESC, source, target LIMIT 10")
def basket_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = ops.graph(ranked(spark, sf_dir))[0].persist()
    node = edges.orderBy(F.desc("lift"), "source", "target").first()  # one row: the selection of a user
    return ops.neighbourhood(edges, node["source"] if node else -1, 10).select("source", "target", F.round("lift", 6).alias("lift"))


NAMES = "names AS (SELECT regexp_extract(p_brand, '[0-9]+')::bigint AS item, min(p_brand) AS name FROM part WHERE p_brand NOT LIKE '%5' GROUP BY 1)"
LABELS = f"""{RULES}, {NAMES}, t AS (SELECT rank, (SELECT string_agg(coalesce(name, i.item::varchar), ' + ' ORDER BY i.item) FROM unnest(antecedent) i(item) LEFT JOIN names ON names.item = i.item) || ' -> ' || (SELECT string_agg(coalesce(name, i.item::varchar), ' + ' ORDER BY i.item) FROM unnest(consequent) i(item) LEFT JOIN names ON names.item = i.item) AS text FROM rules)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parquet(spark, sf_dir, "part", ["p_brand"]).where("p_brand NOT LIKE '%5'")
    names = part.groupBy(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("item")).agg(F.min("p_brand").alias("name"))
    return ops.labelled(ranked(spark, sf_dir), names)


@query(f"{LABELS} SELECT rank, text FROM t")
def basket_rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir)


@query(f"{LABELS} SELECT rank, text FROM t WHERE lower(text) LIKE '%#1%' ORDER BY rank LIMIT 20")
def basket_rule_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).where(F.lower("text").contains("#1")).orderBy("rank").limit(20)


@query(f"{RULES}, b AS (SELECT antecedent, min(rank) AS rank FROM rules GROUP BY 1) SELECT array_to_string(antecedent, '+') AS items, rank FROM b ORDER BY len(antecedent) > 1 DESC, rank LIMIT 4")
def basket_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.presets(ranked(spark, sf_dir)).select(F.array_join(F.col("antecedent").cast("array<string>"), "+").alias("items"), "rank")


#: Trials of the search: number, support, confidence, lift.
TRIALS = [(1, 0.002, 0.02, 1.0), (2, 0.002, 0.10, 1.0), (3, 0.003, 0.02, 1.02), (4, 0.002, 0.02, 1.05), (5, 0.004, 0.02, 1.05), (6, 0.002, 0.05, 1.1), (7, 0.002, 0.02, 1.3)]


@query(f"""{SETS.replace('sets AS', 'sets AS')}, masks AS (SELECT items, support, unnest(range(1, (2 ^ len(items))::int - 1)) AS mask FROM sets WHERE len(items) >= 2),
sides AS (SELECT support, list_filter(items, lambda x, i: (mask // (2 ^ (i - 1))::int) % 2 = 1) AS antecedent, list_filter(items, lambda x, i: (mask // (2 ^ (i - 1))::int) % 2 = 0) AS consequent FROM masks),
r0 AS (SELECT s.support, s.support / a.support AS confidence, s.support / (a.support * c.support) AS lift FROM sides s JOIN sets a ON a.items = antecedent JOIN sets c ON c.items = consequent),
t AS (SELECT * FROM (VALUES {', '.join(map(str, TRIALS))}) v(trial, sup, conf, lf)) SELECT trial::int AS trial, count(r0.lift) AS rules, round(avg(r0.lift), 6) AS mean_lift FROM t LEFT JOIN r0 ON support >= sup AND confidence >= conf AND lift >= lf GROUP BY trial""")
def basket_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).select("trial", "rules", F.round("mean_lift", 6).alias("mean_lift"))


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each trial's rules and mean lift, from one mining at the lowest support and one aggregation."""
    r = ops.rules(mined(spark, sf_dir), 0.0, 0.0)
    keep = lambda t: (F.col("support") >= t[1]) & (F.col("confidence") >= t[2]) & (F.col("lift") >= t[3])
    one = r.agg(*[c for t in TRIALS for c in (F.count_if(keep(t)).alias(f"n{t[0]}"), F.avg(F.when(keep(t), F.col("lift"))).alias(f"m{t[0]}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t[0]).alias("trial"), F.col(f"n{t[0]}").alias("rules"), F.col(f"m{t[0]}").alias("mean_lift")) for t in TRIALS])))


@query()
def basket_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which trials a search keeps that wants a higher mean lift from at least 20 rules."""
    return ops.gate(trials(spark, sf_dir), "mean_lift", F.col("rules") >= 20, 1e-6).withColumn("mean_lift", F.round("mean_lift", 6))


@query(f"{LINES}, s AS (SELECT o_orderkey AS order_id FROM orders ORDER BY md5('sample|' || o_orderkey::varchar), o_orderkey LIMIT 1000) SELECT order_id, count(*) AS items FROM lines SEMI JOIN s USING (order_id) GROUP BY order_id")
def basket_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an exact-size sample of orders, by semi-join."""
    orders = cleaning.exact_sample(parquet(spark, sf_dir, "orders", ["o_orderkey"]).select(F.col("o_orderkey").alias("order_id")), "order_id", 1000, "sample")
    return views.basket_lines(spark, sf_dir).join(orders, "order_id", "left_semi").groupBy("order_id").agg(F.count("*").alias("items"))


RECOMMENDED = f"""{FIRED}, sc AS (SELECT rank, round(lift * confidence, 9) AS score, unnest(consequent) AS item FROM rules WHERE lift >= {STRONG}), h AS (SELECT order_id, item, score, rank FROM fired JOIN sc USING (rank) WHERE NOT EXISTS (SELECT 1 FROM lines WHERE lines.order_id = fired.order_id AND lines.item = sc.item)),
b AS (SELECT *, row_number() OVER (PARTITION BY order_id, item ORDER BY score DESC, rank) AS k FROM h), g AS (SELECT order_id, item, max(score) AS score, min(rank) FILTER (WHERE k = 1) AS rank, array_to_string(list(rank ORDER BY k) FILTER (WHERE k <= 3), ',') AS supporting FROM b GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, item) AS place FROM g)"""
PRICES = "prices AS (SELECT regexp_extract(p_brand, '[0-9]+')::bigint AS item, round(avg(p_retailprice), 2)::decimal(12, 2) AS price FROM part GROUP BY 1)"


@query(f"{RECOMMENDED}, {PRICES}, o AS (SELECT DISTINCT order_id FROM p), v AS (SELECT order_id, sum(price) AS basket_value FROM lines JOIN o USING (order_id) JOIN prices USING (item) GROUP BY 1), a AS (SELECT order_id, sum(price) AS add_on_value FROM p JOIN prices USING (item) WHERE place <= 3 GROUP BY 1) SELECT order_id, basket_value::double AS basket_value, add_on_value::double AS add_on_value FROM v LEFT JOIN a USING (order_id)")
def basket_add_on_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of each basket that has recommendations, and of the first three of them, at the mean price of a brand."""
    part = parquet(spark, sf_dir, "part", ["p_brand", "p_retailprice"])
    prices = part.groupBy(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("item")).agg(F.round(F.avg("p_retailprice"), 2).cast("decimal(12,2)").alias("price"))
    lines = views.basket_lines(spark, sf_dir)
    out = ops.basket_values(lines, ops.recommend(lines, ranked(spark, sf_dir).where(F.col("lift") >= STRONG)), prices)
    return out.select("order_id", *[F.col(c).cast("double").alias(c) for c in ("basket_value", "add_on_value")])
