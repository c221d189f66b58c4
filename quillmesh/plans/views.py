"""Views over the tables on which the queries run, each as DataFrame and as the same SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import parquet

TRIPS_SQL = """trips AS (
  SELECT o_orderkey AS id, (o_orderkey % 2 + 1)::int AS vendor_id,
    o_orderdate + to_seconds((o_orderkey * 37 % 86400)::bigint) AS pickup_datetime,
    (o_orderkey % 8)::int AS passenger_count,
    40.45 + (o_orderkey * 7919 % 10000) / 10000.0::double * 0.5 AS pickup_latitude,
    -74.30 + (o_orderkey * 104729 % 10000) / 10000.0::double * 0.65 AS pickup_longitude,
    40.45 + ((o_custkey * 6101 + o_orderkey * 31) % 10000) / 10000.0::double * 0.5 AS dropoff_latitude,
    -74.30 + ((o_custkey * 3571 + o_orderkey * 17) % 10000) / 10000.0::double * 0.65 AS dropoff_longitude,
    floor(o_totalprice / 20)::int AS trip_duration
  FROM orders)"""


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    spot = lambda e, low, wide: low + e % 10000 / 10000.0 * wide
    return o.select(
        k.alias("id"), (k % 2 + 1).cast("int").alias("vendor_id"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k * 37 % 86400).cast("decimal(18,6)"))).alias("pickup_datetime"),
        (k % 8).cast("int").alias("passenger_count"),
        spot(k * 7919, 40.45, 0.5).alias("pickup_latitude"), spot(k * 104729, -74.30, 0.65).alias("pickup_longitude"),
        spot(c * 6101 + k * 31, 40.45, 0.5).alias("dropoff_latitude"), spot(c * 3571 + k * 17, -74.30, 0.65).alias("dropoff_longitude"),
        F.floor(F.col("o_totalprice") / 20).cast("int").alias("trip_duration"),
    )


BASKETS_SQL = """lines AS (
  SELECT DISTINCT l_orderkey AS order_id, regexp_extract(p_brand, '[0-9]+')::bigint AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def basket_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, item), distinct: the brand numbers bought together."""
    lines = parquet(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    part = parquet(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    rows = lines.join(part, lines["l_partkey"] == part["p_partkey"])
    return rows.select(F.col("l_orderkey").alias("order_id"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("item")).repartition("order_id").distinct()  # dealt once, also for what goes by order


RETAIL_SQL = """retail AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END || l_orderkey::varchar AS invoice, l_orderkey, l_linenumber, upper(p_type) AS stock_code, l_partkey,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, l_extendedprice / l_quantity AS price,
    CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer_id, o_orderdate AS invoice_date,
    CASE WHEN l_linenumber % 5 = 0 THEN lower(p_brand) ELSE p_brand END AS description, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = parquet(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate"])  # noqa: E741
    o = parquet(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    p = parquet(spark, sf_dir, "part", ["p_partkey", "p_type", "p_brand"])
    rows = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(p, l["l_partkey"] == p["p_partkey"])
    back = F.col("l_returnflag") == "R"
    return rows.select(
        F.concat(F.when(back, "C").otherwise(""), F.col("l_orderkey").cast("string")).alias("invoice"), "l_orderkey", "l_linenumber", F.upper("p_type").alias("stock_code"), "l_partkey",
        F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("customer_id"), F.col("o_orderdate").alias("invoice_date"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("description"), "l_shipdate",
    )


CUSTOMERS_SQL = """per_order AS (
  SELECT o_custkey AS customer_id, o_orderkey, o_orderpriority, o_totalprice, o_orderdate FROM orders
), customers AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS segment, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS income,
    count(o_orderkey) AS purchases, count(o_orderkey) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS campaigns,
    count(o_orderkey) FILTER (WHERE o_totalprice < 100000) AS deals, (c_custkey % 11)::bigint AS web_visits,
    coalesce(sum(o_totalprice), 0)::double AS total_spend, date_diff('day', max(o_orderdate)::date, DATE '2002-01-01') AS recency_days,
    (c_custkey % 3)::bigint AS kids, (c_custkey % 2)::bigint AS teens
  FROM customer LEFT JOIN per_order ON c_custkey = customer_id GROUP BY ALL)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"])
    o = parquet(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate"])
    each = o.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("purchases"), F.count_if(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("campaigns"),
        F.count_if(F.col("o_totalprice") < 100000).alias("deals"), F.sum("o_totalprice").alias("total_spend"), F.max("o_orderdate").alias("last"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    return c.join(each, c["c_custkey"] == each["o_custkey"], "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("income"),
        zero("purchases"), zero("campaigns"), zero("deals"), (F.col("c_custkey") % 11).alias("web_visits"), F.coalesce("total_spend", F.lit(0.0)).alias("total_spend"),
        F.date_diff(F.lit("2002-01-01").cast("date"), F.to_date("last")).cast("long").alias("recency_days"), (F.col("c_custkey") % 3).alias("kids"), (F.col("c_custkey") % 2).alias("teens"))


TODAY = "1998-07-01"
TASKS_SQL = """tasks AS (
  SELECT o_orderkey AS id, 'Task ' || (o_orderkey % 977)::varchar AS title, 'for customer ' || o_custkey::varchar AS description,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS priority,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE 'todo' END AS status,
    CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (DATE '1998-07-01' + (o_orderkey % 61 - 30)::int)::date END AS due_date,
    CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE (o_custkey % 5)::int END AS category_id,
    (o_orderkey % 240)::int AS time_spent_minutes, (o_orderkey * 31 % 1009)::int AS order_index,
    o_orderkey % 17 = 0 AS pinned, o_orderkey % 13 = 0 AS archived, o_orderkey % 19 = 0 AS deleted,
    (DATE '1998-07-01' - (o_orderkey % 45)::int)::date AS created_on,
    CASE WHEN o_orderstatus = 'F' THEN (DATE '1998-07-01' - (o_orderkey % 40)::int)::date END AS completed_on
  FROM orders)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"])
    k, today = F.col("o_orderkey"), F.lit(TODAY).cast("date")
    p, s = F.left("o_orderpriority", F.lit(1)), F.col("o_orderstatus")
    return o.select(
        k.alias("id"), F.concat(F.lit("Task "), (k % 977).cast("string")).alias("title"), F.concat(F.lit("for customer "), F.col("o_custkey").cast("string")).alias("description"),
        F.when(p == "1", "urgent").when(p == "2", "high").when(p == "3", "medium").otherwise("low").alias("priority"),
        F.when(s == "F", "completed").when(s == "P", "in_progress").otherwise("todo").alias("status"),
        F.when(k % 6 != 0, F.date_add(today, (k % 61 - 30).cast("int"))).alias("due_date"), F.when(F.col("o_custkey") % 9 != 0, (F.col("o_custkey") % 5).cast("int")).alias("category_id"),
        (k % 240).cast("int").alias("time_spent_minutes"), (k * 31 % 1009).cast("int").alias("order_index"), (k % 17 == 0).alias("pinned"), (k % 13 == 0).alias("archived"), (k % 19 == 0).alias("deleted"),
        F.date_sub(today, (k % 45).cast("int")).alias("created_on"), F.when(s == "F", F.date_sub(today, (k % 40).cast("int"))).alias("completed_on"),
    )
