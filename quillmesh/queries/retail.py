"""Retail lines and user events: flags, revenue, cohorts, funnel, test, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arith import normal_cdf_sql
from ..operators import cleaning, histograms, profile
from ..operators import retail as ops
from ..plans import views
from ..sources.tables import parquet
from .registry import query

PROMO = "stock_code LIKE '%PROMO%'"
FLAGGED = f"""WITH {views.RETAIL_SQL}, lines AS (SELECT *, upper(invoice) LIKE 'C%' AS is_credit_note, {PROMO} AS is_adjustment, quantity < 0 AS is_return, NOT ({PROMO}) AS is_product_line, quantity * price AS line_revenue FROM retail)"""
POPULATION = f"{FLAGGED}, pop AS (SELECT * FROM lines WHERE customer_id IS NOT NULL AND is_product_line AND NOT is_credit_note AND quantity > 0 AND price > 0)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.flagged(views.retail(spark, sf_dir), F.col("stock_code").contains("PROMO"))


@query(f"{FLAGGED} SELECT l_orderkey, l_linenumber, invoice, is_credit_note, is_adjustment, is_return, is_product_line, round(line_revenue, 4) AS line_revenue FROM lines")
def retail_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "invoice", "is_credit_note", "is_adjustment", "is_return", "is_product_line", F.round("line_revenue", 4).alias("line_revenue"))


@query(f"{FLAGGED} SELECT count(*) AS rows, count(*) FILTER (WHERE is_credit_note) AS credit_notes, count(*) FILTER (WHERE is_return) AS return_lines, count(*) FILTER (WHERE is_adjustment) AS adjustment_lines, round(coalesce(sum(line_revenue) FILTER (WHERE is_return), 0), 2) AS returned_value FROM lines")
def retail_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.events(lines(spark, sf_dir)).withColumn("returned_value", F.round("returned_value", 2))


@query(f"{POPULATION} SELECT customer_id, count(*) AS n, round(sum(line_revenue), 2) AS spent, min(invoice_date)::date AS first_day FROM pop GROUP BY customer_id")
def retail_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.population(lines(spark, sf_dir)).groupBy("customer_id").agg(F.count("*").alias("n"), F.round(F.sum("line_revenue"), 2).alias("spent"), F.to_date(F.min("invoice_date")).alias("first_day"))


DAILY = f"{FLAGGED}, daily AS (SELECT invoice_date::date AS date, sum(line_revenue) AS net_revenue, coalesce(sum(line_revenue) FILTER (WHERE quantity > 0), 0) AS gross_sales FROM lines WHERE is_product_line GROUP BY 1)"


@query(f"{DAILY} SELECT date, round(net_revenue, 2) AS net_revenue, round(gross_sales, 2) AS gross_sales FROM daily ORDER BY date DESC LIMIT 90")
def retail_daily_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.daily_revenue(lines(spark, sf_dir), 90).select("date", F.round("net_revenue", 2).alias("net_revenue"), F.round("gross_sales", 2).alias("gross_sales"))


@query(f"""{DAILY}, cal AS (SELECT unnest(generate_series((SELECT min(date) FROM daily)::timestamp, (SELECT max(date) FROM daily)::timestamp, INTERVAL 1 DAY))::date AS date),
s AS (SELECT date, coalesce(net_revenue, 0) AS v, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS total FROM cal LEFT JOIN daily USING (date)),
m AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(v) OVER w END AS mid FROM s WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
l AS (SELECT regr_slope(mid, pos) FILTER (WHERE pos BETWEEN 3 AND 9) AS ls, regr_intercept(mid, pos) FILTER (WHERE pos BETWEEN 3 AND 9) AS li, regr_slope(mid, pos) FILTER (WHERE pos BETWEEN total - 10 AND total - 4) AS hs, regr_intercept(mid, pos) FILTER (WHERE pos BETWEEN total - 10 AND total - 4) AS hi FROM m),
t AS (SELECT m.*, coalesce(mid, CASE WHEN pos < 3 THEN li + ls * pos ELSE hi + hs * pos END) AS trend FROM m, l),
p AS (SELECT pos % 7 AS place, avg(v - trend) AS part FROM t GROUP BY 1), q AS (SELECT place, part - avg(part) OVER () AS seasonal FROM p)
SELECT date, round(v, 2) AS net_revenue, round(trend, 3) AS trend, round(seasonal, 3) AS seasonal, round(v - trend - seasonal, 3) AS residual FROM t JOIN q ON pos % 7 = place""")
def retail_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ops.calendar(ops.daily_revenue(lines(spark, sf_dir)), "date", ["net_revenue"])
    return ops.centred_trend(daily, "date", "net_revenue").select("date", F.round("net_revenue", 2).alias("net_revenue"), *[F.round(c, 3).alias(c) for c in ("trend", "seasonal", "residual")])


COHORTS = f"""{POPULATION}, months AS (SELECT DISTINCT customer_id, year(invoice_date) * 12 + month(invoice_date) AS month FROM pop), c AS (SELECT *, min(month) OVER (PARTITION BY customer_id) AS cohort FROM months),
a AS (SELECT cohort, month - cohort AS period, count(*) AS active FROM c GROUP BY ALL), s AS (SELECT cohort, active AS size FROM a WHERE period = 0),
g AS (SELECT cohort, size, unnest(range(0, (SELECT max(month) FROM c) - cohort + 1)) AS period FROM s), full_grid AS (SELECT g.cohort, g.period::int AS period, coalesce(active, 0) AS active, size, round(coalesce(active, 0) / size * 100, 1) AS retention FROM g LEFT JOIN a USING (cohort, period))"""


@query(f"{COHORTS} SELECT cohort::int AS cohort, period, active, size, retention FROM full_grid")
def retail_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cohorts(ops.population(lines(spark, sf_dir)), "customer_id", "invoice_date").select("cohort", "period", "active", "size", "retention")


@query(f"{COHORTS} SELECT cohort::int AS cohort, count(*) AS periods, array_to_string(list(retention ORDER BY period), ' ') AS retention FROM full_grid GROUP BY cohort")
def retail_cohort_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each cohort, its retention in every period that can be observed, from 0 on."""
    wide = ops.cohort_matrix(ops.cohorts(ops.population(lines(spark, sf_dir)), "customer_id", "invoice_date"))
    cells = F.array_compact(F.array(*[F.col(c).cast("string") for c in wide.columns if c != "cohort"]))
    return wide.select("cohort", F.size(cells).cast("long").alias("periods"), F.array_join(cells, " ").alias("retention"))


AUDIT = ("l_orderkey", "invoice", "stock_code", "description", "quantity", "price", "customer_id")
AUDIT_RULES = {"price": "price <= 1000", "description": "regexp_matches(description, '^brand')", "customer_id": "customer_id % 100 = 7"}


def audit_rules() -> dict:
    return {"price": F.col("price") <= 1000, "description": F.col("description").rlike("^brand"), "customer_id": F.col("customer_id") % 100 == 7}


def _audit_sql(c: str) -> str:
    number = c in ("l_orderkey", "quantity", "price", "customer_id")
    measured = c in ("quantity", "price")
    far = f"(SELECT count(*) FROM retail, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM retail) q WHERE b - a > 0 AND ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a)))" if measured else "0::bigint"
    least = f"printf('%s', min({c}))" if not measured else f"min({c})::varchar"
    return f"SELECT '{c}' AS \"column\", count(*) AS rows, count(DISTINCT {c}) AS \"distinct\", count(*) - count({c}) AS nulls, round((count(*) - count({c})) / count(*) * 100, 6) AS null_pct, {least} AS min, {f'round(avg({c}), 6)' if number else 'NULL::double'} AS mean, {f'count(*) FILTER (WHERE {AUDIT_RULES[c]})' if c in AUDIT_RULES else '0::bigint'} AS invalid, {far} AS outliers FROM retail"


@query(f"WITH {views.RETAIL_SQL} SELECT * EXCLUDE (min) FROM ({' UNION ALL '.join(_audit_sql(c) for c in AUDIT)})")
def retail_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile(views.retail(spark, sf_dir).select(*AUDIT), audit_rules(), ("l_orderkey", "customer_id")).drop("min")


SPELLINGS = f"""WITH {views.RETAIL_SQL}, c AS (SELECT upper(trim(description)) AS folded, description AS surface, count(*) AS n FROM retail GROUP BY ALL), o AS (SELECT folded, surface, first_value(surface) OVER (PARTITION BY folded ORDER BY n DESC, surface) AS preferred, n FROM c)"""


@query(f"{SPELLINGS} SELECT * FROM o WHERE surface <> preferred")
def retail_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.other_spellings(views.retail(spark, sf_dir), "description")


@query(f"""{SPELLINGS}, p AS ({' UNION ALL '.join(_audit_sql(c) for c in AUDIT)}), r AS (SELECT (SELECT count(*) FROM retail) - count(*) AS repeated FROM (SELECT DISTINCT {', '.join(AUDIT)} FROM retail)), i AS (SELECT coalesce(sum(n), 0) AS bad FROM o WHERE surface <> preferred),
t AS (SELECT max(rows) AS rows, max(repeated) AS repeated, (1 - sum(nulls) / sum(rows)) * 100 AS completeness, (1 - sum(invalid) / (sum(rows) - sum(nulls))) * 100 AS validity, (1 - max(repeated) / max(rows)) * 100 AS uniqueness, (1 - max(bad) / (sum(rows) - sum(nulls))) * 100 AS consistency FROM p, r, i),
s AS (SELECT *, completeness * 0.35 + validity * 0.30 + uniqueness * 0.20 + consistency * 0.15 AS score FROM t)
SELECT rows, repeated, round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(uniqueness, 6) AS uniqueness, round(consistency, 6) AS consistency, round(score, 6) AS score,
CASE WHEN completeness < 80 OR validity < 80 OR score < 75 THEN 'CRITICAL' WHEN completeness < 95 OR validity < 95 OR score < 90 THEN 'WARNING' ELSE 'PASS' END AS health FROM s""")
def retail_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.retail(spark, sf_dir).select(*AUDIT)
    bad = profile.other_spellings(df, "description").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inconsistent"))
    return profile.composite(profile.profile(df, audit_rules(), ("l_orderkey", "customer_id")), cleaning.repeated_rows(df), bad)


STAGES = ["view", "click", "add_to_cart", "purchase", "signup"]


@query("""WITH u AS (SELECT event_type AS stage, count(DISTINCT user_id) AS users FROM events GROUP BY 1), s AS (SELECT step::int AS step, stage, coalesce(users, 0) AS users FROM (VALUES (0, 'view'), (1, 'click'), (2, 'add_to_cart'), (3, 'purchase'), (4, 'signup')) v(step, stage) LEFT JOIN u USING (stage)),
w AS (SELECT *, first_value(users) OVER (ORDER BY step) AS top, lag(users) OVER (ORDER BY step) AS before FROM s)
SELECT step, stage, users, round(users * 100.0::double / nullif(top, 0), 6) AS share_of_top_pct, CASE WHEN before IS NULL THEN 100.0::double ELSE round(users * 100.0::double / nullif(before, 0), 6) END AS step_conversion_pct, CASE WHEN before IS NULL THEN 0.0::double ELSE round((before - users) * 100.0::double / nullif(before, 0), 6) END AS step_dropoff_pct FROM w""")
def events_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.funnel(parquet(spark, sf_dir, "events", ["user_id", "event_type"]), "user_id", "event_type", STAGES)




@query(f"""WITH u AS (SELECT user_id, (user_id % 2)::int AS arm, max((event_type = 'purchase' AND value > 90)::int) AS bought FROM events GROUP BY 1, 2), a AS (SELECT count(*) FILTER (WHERE arm = 0) AS n0, (sum(bought) FILTER (WHERE arm = 0))::bigint AS x0, count(*) FILTER (WHERE arm = 1) AS n1, (sum(bought) FILTER (WHERE arm = 1))::bigint AS x1 FROM u),
p AS (SELECT *, x0 / n0 AS p0, x1 / n1 AS p1, (x0 + x1) / (n0 + n1) AS pooled FROM a), s AS (SELECT *, sqrt(pooled * (1 - pooled) * (1 / n0 + 1 / n1)) AS se, sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1) AS sd FROM p), z AS (SELECT *, CASE WHEN se = 0 THEN 0 ELSE (p1 - p0) / se END AS z, (p1 - p0) * 100 AS lift FROM s),
r AS (SELECT *, CASE WHEN se = 0 THEN 1 ELSE 2 * (1 - {normal_cdf_sql('abs(z)')}) END AS p_value, lift - 1.959963984540054 * sd * 100 AS low, lift + 1.959963984540054 * sd * 100 AS high, abs(p1 - p0) / nullif(sd, 0) AS eff FROM z)
SELECT n0, x0, n1, x1, round(z, 6) AS z, round(p_value, 6) AS p_value, round(lift, 6) AS lift_pp, round((p1 - p0) / greatest(p0, 1e-12) * 100, 6) AS relative_pct, round(low, 6) AS low_pp, round(high, 6) AS high_pp,
round(coalesce({normal_cdf_sql('(eff - 1.959963984540054)')} + {normal_cdf_sql('(-eff - 1.959963984540054)')}, 0), 6) AS power, CASE WHEN p_value >= 0.05 THEN 'no evidence' WHEN lift < 0 THEN 'harmful' WHEN low >= 0.5 THEN 'ship' ELSE 'small' END AS advice, least(x0, n0 - x0) < 10 OR least(x1, n1 - x1) < 10 AS unreliable FROM r""")
def events_ab_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events", ["user_id", "event_type", "value"])
    users = e.groupBy("user_id").agg(F.max(((F.col("event_type") == "purchase") & (F.col("value") > 90)).cast("int")).alias("bought")).withColumn("arm", F.col("user_id") % 2)
    arms = users.agg(*[c for a in (0, 1) for c in (F.count_if(F.col("arm") == a).alias(f"n{a}"), F.sum(F.when(F.col("arm") == a, F.col("bought"))).alias(f"x{a}"))])
    out = ops.two_proportions(arms)
    return out.select("n0", "x0", "n1", "x1", *[F.round(c, 6).alias(c) for c in ("z", "p_value", "lift_pp", "relative_pct", "low_pp", "high_pp", "power")], "advice", "unreliable")


@query("""WITH c AS (SELECT ts::date AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT * FROM c""")
def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming daily counts: a tumbling window of one day."""
    e = parquet(spark, sf_dir, "events", ["ts", "event_type", "value"])
    day = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return day.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@query("""WITH c AS (SELECT ts::date AS day, count(*) FILTER (WHERE event_type = 'signup') AS created, count(*) FILTER (WHERE event_type = 'purchase') AS completed FROM events GROUP BY 1), g AS (SELECT (DATE '2024-01-30' - i::int)::date AS day FROM range(30) r(i))
SELECT day, coalesce(completed, 0) AS completed, coalesce(created, 0) AS created, (CASE WHEN coalesce(completed, 0) >= 4 THEN 4 WHEN coalesce(completed, 0) >= 2 THEN 3 WHEN coalesce(completed, 0) >= 1 THEN 2 WHEN coalesce(created, 0) >= 1 THEN 1 ELSE 0 END)::int AS level FROM g LEFT JOIN c USING (day)""")
def events_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tasks import heat_level

    e = parquet(spark, sf_dir, "events", ["ts", "event_type"])
    counts = e.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "signup").alias("created"))
    grid = spark.range(30).select(F.date_sub(F.lit("2024-01-30").cast("date"), F.col("id").cast("int")).alias("day"))
    return histograms.dense(grid, counts, ["day"], ["completed", "created"]).withColumn("level", heat_level(F.col("completed"), F.col("created")))


@query("""WITH c AS (SELECT user_id, ts::date AS day FROM events WHERE event_type = 'purchase' GROUP BY ALL), u AS (SELECT DISTINCT user_id FROM events), g AS (SELECT user_id, i::int AS back, (DATE '2024-01-30' - i::int)::date AS day FROM u, range(30) r(i)),
a AS (SELECT g.user_id, back, c.day IS NOT NULL AS active FROM g LEFT JOIN c USING (user_id, day)), b AS (SELECT user_id, min(back) FILTER (WHERE NOT active AND back > 0) AS gap, max(CASE WHEN back = 0 THEN active::int END) AS today FROM a GROUP BY 1)
SELECT user_id, (coalesce(gap, 30) - 1 + today)::int AS streak FROM b""")
def events_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tasks import streaks

    e = parquet(spark, sf_dir, "events", ["user_id", "ts", "event_type"])
    return streaks(e.select("user_id", F.to_date("ts").alias("day"), (F.col("event_type") == "purchase").alias("hit")), "user_id", "day", "hit", "2024-01-30", 30)


@query("""SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def events_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parquet(spark, sf_dir, "events", ["event_id", "ts", "event_type"]).orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)


