"""Task lists on a view of the orders; changes on views of orders and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import capture
from ..operators import tasks as ops
from ..plans import views
from ..sources.tables import parquet
from .registry import query

W = f"WITH {views.TASKS_SQL}"
T = "DATE '1998-07-01'"
BUCKET = f"CASE WHEN status = 'completed' THEN 'completed' WHEN due_date IS NULL THEN 'no_date' WHEN due_date < {T} THEN 'overdue' WHEN due_date = {T} THEN 'today' WHEN due_date = {T} + 1 THEN 'tomorrow' ELSE 'upcoming' END"
IMPORTANT = "priority IN ('urgent', 'high')"
URGENT = f"(priority = 'urgent' OR coalesce(due_date <= {T}, false))"
QUADRANT = f"CASE WHEN status = 'completed' THEN NULL WHEN {URGENT} AND {IMPORTANT} THEN 'do_first' WHEN {IMPORTANT} THEN 'schedule' WHEN {URGENT} THEN 'delegate' ELSE 'eliminate' END"
SCOPE = "CASE WHEN deleted THEN 'trash' WHEN archived THEN 'archive' ELSE 'active' END"
LISTS = {"all": "true", "today": f"due_date = {T}", "upcoming": f"due_date > {T} + 1", "important": IMPORTANT, "completed": "status = 'completed'"}
PCT = lambda a, b: f"CASE WHEN {b} > 0 THEN floor({a} / {b} * 100 + 0.5)::bigint ELSE 0 END"


def today() -> Column:
    return F.lit(views.TODAY).cast("date")


@query(f"{W} SELECT id, {SCOPE} AS scope, {BUCKET} AS bucket, {QUADRANT} AS quadrant, status <> 'completed' AND coalesce(due_date < {T}, false) AS overdue, coalesce(due_date = {T}, false) AS due_today FROM tasks")
def task_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tasks(spark, sf_dir)
    return t.select("id", ops.scope().alias("scope"), ops.bucket(today()).alias("bucket"), ops.quadrant(today()).alias("quadrant"), ops.overdue(today()).alias("overdue"), F.coalesce(F.col("due_date") == today(), F.lit(False)).alias("due_today"))


MOVES = {"do_first": ("'urgent'", T), "schedule": ("'high'", f"CASE WHEN due_date <= {T} THEN ({T} + 1)::date ELSE due_date END"), "delegate": ("'medium'", T), "eliminate": ("'low'", f"CASE WHEN coalesce(due_date <= {T}, false) THEN NULL ELSE due_date END")}


@query(f"{W} " + " UNION ALL ".join(f"SELECT id, '{q}' AS target, {p} AS priority, {d}::date AS due_date FROM tasks" for q, (p, d) in MOVES.items()))
def task_quadrant_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.tasks(spark, sf_dir)
    moves = F.array(*[F.struct(F.lit(q).alias("target"), ops.moved(q, today())["priority"].alias("priority"), ops.moved(q, today())["due_date"].alias("due_date")) for q in MOVES])
    return t.select("id", F.inline(moves))


ORDERS = {"custom": "order_index, id", "due_asc": "due_date ASC NULLS LAST, order_index, id", "due_desc": "due_date DESC NULLS LAST, order_index, id", "priority": "CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, order_index, id", "title": "lower(title), id", "recent": "created_on DESC, id DESC"}


@query(f"{W} SELECT id, {', '.join(f'row_number() OVER (ORDER BY pinned DESC, {o}) AS {n}' for n, o in ORDERS.items())} FROM tasks WHERE NOT archived AND NOT deleted")
def task_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.sort_ranks(views.tasks(spark, sf_dir).where(ops.scope() == "active"), ops.SORTS).select("id", *ops.SORTS)


@query(f"{W} SELECT id, title FROM tasks WHERE {SCOPE} = 'active' AND {LISTS['important']} AND category_id = 2 AND (lower(title) LIKE '%9%' OR lower(description) LIKE '%9%')")
def task_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.filtered(views.tasks(spark, sf_dir), today(), "active", "important", 2, "9").select("id", "title")


@query(f"{W} SELECT {', '.join(f'count(*) FILTER (WHERE {SCOPE} = $$active$$ AND coalesce({c}, false)) AS list_{n}' for n, c in LISTS.items())}, count(*) FILTER (WHERE {SCOPE} = 'archive') AS archive, count(*) FILTER (WHERE {SCOPE} = 'trash') AS trash FROM tasks")
def task_sidebar(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = ops.scope() == "active"
    return views.tasks(spark, sf_dir).agg(*[F.count_if(active & ops.in_list(n, today())).alias(f"list_{n}") for n in ops.SMART], F.count_if(ops.scope() == "archive").alias("archive"), F.count_if(ops.scope() == "trash").alias("trash"))


def _breakdown_sql(column: str, values: list, none: str | None = None) -> str:
    value = f"{column}::varchar" if none is None else f"CASE WHEN {column}::varchar IN ({', '.join(repr(str(v)) for v in values)}) THEN {column}::varchar ELSE '{none}' END"
    frame = ", ".join(f"('{v}')" for v in [*values, *([none] if none else [])])
    return f"{W}, a AS (SELECT {value} AS value, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed FROM tasks WHERE {SCOPE} = 'active' GROUP BY 1), f AS (SELECT v.value, coalesce(total, 0) AS total, coalesce(completed, 0) AS completed FROM (VALUES {frame}) v(value) LEFT JOIN a USING (value)), w AS (SELECT sum(total) AS n FROM f) SELECT value, total, completed, {PCT('completed', 'total')} AS completion_pct, {PCT('total', 'n')} AS share_pct FROM f, w"


@query(_breakdown_sql("priority", list(ops.PRIORITIES)))
def task_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.breakdown(views.tasks(spark, sf_dir), "priority", list(ops.PRIORITIES))


@query(_breakdown_sql("category_id", [0, 1, 2, 7], "Uncategorized"))
def task_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.breakdown(views.tasks(spark, sf_dir), "category_id", [0, 1, 2, 7], "Uncategorized")


@query(_breakdown_sql("status", list(ops.STATUSES)))
def task_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.breakdown(views.tasks(spark, sf_dir), "status", list(ops.STATUSES))


@query(f"""{W}, a AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status <> 'completed' AND due_date < {T}) AS overdue, sum(time_spent_minutes)::bigint AS focus_minutes FROM tasks WHERE {SCOPE} = 'active'), r AS (SELECT *, {PCT('completed', 'total')} AS completion_rate FROM a)
SELECT total, completed, overdue, focus_minutes, completion_rate, floor(focus_minutes / 6 + 0.5) / 10 AS focus_hours, greatest(10, least(100, floor(completion_rate * 0.7::double + 0.5) + 20 - least(overdue * 10, 30) + 20))::bigint AS productivity_index FROM r""")
def task_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a streak of ten days, which counts as much as any from four on."""
    return ops.headline(views.tasks(spark, sf_dir), today(), F.lit(10)).select("total", "completed", "overdue", "focus_minutes", "completion_rate", "focus_hours", "productivity_index")


@query(f"""{W}, n AS (SELECT due_date, count(*) AS n FROM tasks GROUP BY 1), g AS (SELECT (DATE '1998-06-28' + i::int)::date AS date FROM range(35) r(i)) SELECT date, month(date) = 7 AS in_month, coalesce(n, 0) AS n FROM g LEFT JOIN n ON due_date = date""")
def task_month_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.month_grid(views.tasks(spark, sf_dir), 1998, 7, "due_date")


CAPTURE = """lines AS (SELECT event_id, 'Call ' || event_type || ' !' || CASE event_id % 4 WHEN 0 THEN 'crit' WHEN 1 THEN 'H' WHEN 2 THEN 'odd' ELSE 'low' END || ' #Tag' || (user_id % 3)::varchar || ' #home ~' || CASE event_id % 3 WHEN 0 THEN '1.5h' WHEN 1 THEN '45' ELSE '20min' END
  || ' @' || CASE event_id % 5 WHEN 0 THEN 'today' WHEN 1 THEN 'fri,' WHEN 2 THEN '1998-02-30' WHEN 3 THEN '1998-12-24' ELSE 'tomorrow' END AS text FROM events)"""


def capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "events", ["event_id", "event_type", "user_id"])
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("event_id") % n + 1).cast("int"))
    return e.select("event_id", F.concat(F.lit("Call "), "event_type", F.lit(" !"), pick(4, "crit", "H", "odd", "low"), F.lit(" #Tag"), (F.col("user_id") % 3).cast("string"), F.lit(" #home ~"), pick(3, "1.5h", "45", "20min"), F.lit(" @"), pick(5, "today", "fri,", "1998-02-30", "1998-12-24", "tomorrow")).alias("text"))


@query(f"""WITH {CAPTURE} SELECT event_id, 'Call ' || regexp_extract(text, 'Call (\\S+)', 1) || CASE WHEN event_id % 5 = 1 THEN ' ,' ELSE '' END AS title,
CASE event_id % 4 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS priority, array_to_string(list_transform(regexp_extract_all(text, '#([A-Za-z0-9_-]+)', 1), lambda x: lower(x)), ',') AS tags,
CASE event_id % 3 WHEN 0 THEN 90 WHEN 1 THEN 45 ELSE 20 END::bigint AS minutes, CASE event_id % 5 WHEN 0 THEN {T} WHEN 1 THEN DATE '1998-07-03' WHEN 2 THEN NULL WHEN 3 THEN DATE '1998-12-24' ELSE {T} + 1 END::date AS due FROM lines""")
def capture_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = capture_lines(spark, sf_dir).withColumn("c", capture.capture(F.col("text"), today()))
    return c.select("event_id", "c.title", "c.priority", F.array_join("c.tags", ",").alias("tags"), "c.minutes", "c.due")


CHANGES = "changes AS (SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'complete' WHEN 1 THEN 'uncomplete' WHEN 2 THEN 'priority' WHEN 3 THEN 'category' WHEN 4 THEN 'trash' WHEN 5 THEN 'restore' WHEN 6 THEN 'purge' WHEN 7 THEN 'archive' ELSE 'unarchive' END AS action, CASE o_orderkey % 9 WHEN 2 THEN 'low' WHEN 3 THEN '4' END AS value FROM orders WHERE o_custkey % 2 = 0)"
CHANGED = f"""{W}, {CHANGES}, j AS (SELECT tasks.*, action, value FROM tasks LEFT JOIN changes USING (id) WHERE coalesce(action, '') <> 'purge'),
n AS (SELECT *, CASE WHEN action = 'complete' THEN 'completed' WHEN action = 'uncomplete' AND status = 'completed' THEN 'todo' ELSE status END AS new_status,
  CASE WHEN action = 'complete' THEN coalesce(completed_on, {T}) WHEN action = 'uncomplete' THEN NULL ELSE completed_on END AS new_completed_on, CASE WHEN action = 'priority' THEN value ELSE priority END AS new_priority,
  CASE WHEN action = 'category' THEN value::int ELSE category_id END AS new_category_id, CASE action WHEN 'trash' THEN true WHEN 'restore' THEN false ELSE deleted END AS new_deleted, CASE action WHEN 'archive' THEN true WHEN 'unarchive' THEN false ELSE archived END AS new_archived FROM j),
c AS (SELECT *, concat_ws(', ', {', '.join(f"CASE WHEN new_{f} IS DISTINCT FROM {f} THEN '{f}' END" for f in ('status', 'completed_on', 'priority', 'category_id', 'deleted', 'archived'))}) AS details FROM n)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = parquet(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).where("o_custkey % 2 = 0")
    names = ("complete", "uncomplete", "priority", "category", "trash", "restore", "purge", "archive", "unarchive")
    k = (F.col("o_orderkey") % 9).cast("int")
    return o.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*[F.lit(n) for n in names]), k + 1).alias("action"), F.when(k == 2, "low").when(k == 3, "4").alias("value"))


@query(f"{CHANGED} SELECT id, new_status AS status, new_completed_on::date AS completed_on, new_priority AS priority, new_category_id AS category_id, new_deleted AS deleted, new_archived AS archived FROM c")
def task_bulk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.bulk(views.tasks(spark, sf_dir), changes(spark, sf_dir), today()).select("id", "status", "completed_on", "priority", "category_id", "deleted", "archived")


@query(f"{CHANGED} SELECT id AS task_id, title AS task_title, 'bulk' AS action, details FROM c WHERE details <> ''")
def task_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.audit(ops.bulk(views.tasks(spark, sf_dir), changes(spark, sf_dir), today()), F.lit("bulk"))


@query(f"""{W}, e AS (SELECT l_orderkey AS id, (l_quantity * 60)::bigint AS minutes FROM lineitem), s AS (SELECT id, sum(minutes)::bigint AS more FROM e WHERE minutes BETWEEN 1 AND 1440 GROUP BY 1) SELECT id, time_spent_minutes + CASE WHEN deleted THEN 0 ELSE coalesce(more, 0) END AS time_spent_minutes FROM tasks LEFT JOIN s USING (id)""")
def task_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = parquet(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"]).select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") * 60).cast("long").alias("minutes"))
    return ops.add_minutes(views.tasks(spark, sf_dir), e).select("id", F.col("time_spent_minutes").cast("long").alias("time_spent_minutes"))


@query("""WITH log AS (SELECT user_id AS task_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'todo' WHEN 'signup' THEN 'completed' ELSE 'in_progress' END AS status, event_id % 7 = 0 AS flag FROM events),
o AS (SELECT task_id, arg_max(status, seq) AS status, arg_max(flag, seq) AS flag, count(*) AS changes, max(seq) FILTER (WHERE status <> 'completed') AS reopened FROM log GROUP BY 1)
SELECT task_id, o.status, o.flag, CASE WHEN o.status = 'completed' THEN (SELECT min(seq) FROM log l WHERE l.task_id = o.task_id AND l.status = 'completed' AND seq > coalesce(reopened, -1)) END AS completed_seq, changes FROM o""")
def task_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.replay(task_log(parquet(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])))


def task_log(e: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type").isin("purchase", "signup"), "completed").when(F.col("event_type") == "click", "todo").otherwise("in_progress")
    return e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), status.alias("status"), (F.col("event_id") % 7 == 0).alias("flag"))


@query("""WITH v AS (SELECT DISTINCT lower(regexp_replace(trim(p_type), '^#+', '')) AS name FROM part), t AS (SELECT name FROM v WHERE length(name) BETWEEN 1 AND 30) SELECT name, ('0x' || substr(sha1(name), 1, 4))::bigint % 8 AS colour FROM t""")
def tag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by name, created once, each with a colour picked by its hash."""
    t = parquet(spark, sf_dir, "part", ["p_type"]).select(capture.tag_name(F.col("p_type")).alias("name")).where("name IS NOT NULL").distinct()
    return t.withColumn("colour", F.conv(F.substring(F.sha1("name"), 1, 4), 16, 10).cast("long") % 8)


NESTED = f"{W}, subtasks AS (SELECT l_orderkey AS task_id, l_linenumber AS position, l_partkey AS id, l_linestatus = 'F' AS completed FROM lineitem), tags AS (SELECT DISTINCT l_orderkey AS task_id, 'brand-' || regexp_extract(p_brand, '[0-9]+') AS name FROM lineitem JOIN part ON l_partkey = p_partkey)"


def subtasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = parquet(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_linestatus"])  # noqa: E741
    return l.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("id"), (F.col("l_linestatus") == "F").alias("completed"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.basket_lines(spark, sf_dir).select(F.col("order_id").alias("task_id"), F.concat(F.lit("brand-"), F.col("item").cast("string")).alias("name"))


@query(f"""{NESTED}, s AS (SELECT task_id, array_to_string(list(position || ':' || id || ':' || CASE WHEN completed THEN 'x' ELSE '' END ORDER BY position, id, completed), ' ') AS steps, count(*) FILTER (WHERE completed) AS done, count(*) AS total FROM subtasks GROUP BY 1), g AS (SELECT task_id, array_to_string(list(name ORDER BY name), ' ') AS names FROM tags GROUP BY 1)
SELECT tasks.id, coalesce(steps, '') AS steps, coalesce(done, 0) AS subtasks_done, coalesce(total, 0) AS subtasks_total, coalesce(names, '') AS tags FROM tasks LEFT JOIN s ON s.task_id = tasks.id LEFT JOIN g ON g.task_id = tasks.id""")
def task_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task with its ordered subtasks and tags."""
    t = ops.nested(views.tasks(spark, sf_dir).select("id"), subtasks(spark, sf_dir), tags(spark, sf_dir))
    step = lambda x: F.concat_ws(":", x["position"].cast("string"), x["id"].cast("string"), F.when(x["completed"], "x").otherwise(""))
    return t.select("id", F.array_join(F.transform("subtasks", step), " ").alias("steps"), "subtasks_done", "subtasks_total", F.array_join("tags", " ").alias("tags"))


@query(f"{NESTED} SELECT id, title FROM tasks JOIN tags ON task_id = id AND name = 'brand-23' WHERE {SCOPE} = 'active' AND {LISTS['important']}")
def task_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tagged(ops.filtered(views.tasks(spark, sf_dir), today(), "active", "important"), tags(spark, sf_dir), "brand-23").select("id", "title")


@query(f"""{NESTED}, c AS (SELECT 'category' AS kind, k::varchar AS name, (SELECT count(*) FROM tasks WHERE category_id = k AND {SCOPE} = 'active') AS active FROM range(0, 7) AS r(k)), g AS (SELECT 'tag' AS kind, name, count(tasks.id) FILTER (WHERE {SCOPE} = 'active') AS active FROM tags LEFT JOIN tasks ON tasks.id = task_id GROUP BY name) SELECT * FROM c UNION ALL SELECT * FROM g""")
def task_owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active tasks of each category, those without any too, and of each tag."""
    t, g = views.tasks(spark, sf_dir), tags(spark, sf_dir)
    categories = ops.active_counts(spark.range(7).select(F.col("id").cast("int").alias("category_id")), "category_id", t)
    named = ops.active_counts(g.select("name").distinct(), "name", t.join(g, F.col("id") == F.col("task_id")))
    return categories.select(F.lit("category").alias("kind"), F.col("category_id").cast("string").alias("name"), "active").unionByName(named.select(F.lit("tag").alias("kind"), "name", "active"))


@query(f"""{W}, m AS (SELECT id, CASE status WHEN 'todo' THEN 'in_progress' WHEN 'in_progress' THEN 'completed' ELSE 'todo' END AS col, (id % 50)::int AS place FROM tasks WHERE id % 3 = 0)
SELECT tasks.id, coalesce(col, status) AS status, coalesce(place, order_index)::int AS order_index, CASE WHEN col IS NULL THEN completed_on WHEN col = 'completed' THEN coalesce(completed_on, {T}) END AS completed_on FROM tasks LEFT JOIN m ON m.id = tasks.id""")
def task_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks dragged to the next column and a new place there."""
    t = views.tasks(spark, sf_dir)
    moves = t.where("id % 3 = 0").select("id", F.when(F.col("status") == "todo", "in_progress").when(F.col("status") == "in_progress", "completed").otherwise("todo").alias("column"), (F.col("id") % 50).cast("int").alias("place"))
    return ops.moved_rows(t, moves, today()).select("id", "status", "order_index", "completed_on")


@query(f"{W} SELECT id, CASE WHEN category_id NOT IN (1, 3) THEN category_id END AS category_id FROM tasks")
def task_category_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.range(1, 4, 2).select(F.col("id").cast("int").alias("category_id"))
    return ops.without_categories(views.tasks(spark, sf_dir), gone).select("id", "category_id")


@query(f"""{W}, c AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'New ' || id END AS title, CASE WHEN id % 5 = 0 THEN 'low' END AS priority FROM tasks WHERE id % 4 < 2)
SELECT tasks.id, coalesce(c.title, tasks.title) AS patched_title, coalesce(c.priority, tasks.priority) AS patched_priority, CASE WHEN c.id IS NULL THEN tasks.title ELSE c.title END AS replaced_title, CASE WHEN c.id IS NULL THEN tasks.priority ELSE c.priority END AS replaced_priority FROM tasks LEFT JOIN c ON c.id = tasks.id""")
def task_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes as patch and as full replacement."""
    t = views.tasks(spark, sf_dir).select("id", "title", "priority")
    changes = t.where("id % 4 < 2").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), F.col("id").cast("string"))).alias("title"), F.when(F.col("id") % 5 == 0, "low").alias("priority"))
    both = [ops.patched(t, changes, ["title", "priority"], replace).select("id", F.col("title").alias(f"{n}_title"), F.col("priority").alias(f"{n}_priority")) for n, replace in (("patched", False), ("replaced", True))]
    return both[0].join(both[1], "id")


RAW = "raw AS (SELECT id, CASE WHEN id % 7 = 0 THEN ' ' WHEN id % 41 = 0 THEN repeat('x', 501) ELSE title END AS title, CASE WHEN id % 11 = 0 THEN 'asap' ELSE priority END AS priority, status, CASE WHEN id % 23 = 0 THEN '2020-13-01' WHEN id % 29 = 0 THEN '1 May' ELSE due_date::varchar END AS due_date, category_id, NULL::varchar AS estimated_minutes, CASE WHEN id % 31 = 0 THEN '-5' WHEN id % 37 = 0 THEN 'ten' ELSE time_spent_minutes::varchar END AS time_spent_minutes FROM tasks)"


@query(f"""{W}, {RAW} SELECT id, 'title' AS field, 'required' AS reason FROM raw WHERE trim(title) = '' UNION ALL SELECT id, 'title', 'too long' FROM raw WHERE length(trim(title)) > 500 UNION ALL SELECT id, 'priority', 'invalid' FROM raw WHERE priority = 'asap'
UNION ALL SELECT id, 'due_date', 'not YYYY-MM-DD' FROM raw WHERE due_date IS NOT NULL AND try_cast(due_date AS date) IS NULL UNION ALL SELECT id, 'time_spent_minutes', 'not a whole number of minutes' FROM raw WHERE time_spent_minutes IS NOT NULL AND NOT coalesce(try_cast(time_spent_minutes AS bigint) BETWEEN 0 AND 100000, false)
UNION ALL SELECT id, 'category_id', 'does not exist' FROM raw WHERE category_id = 4""")
def task_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the rules of a task, on raw rows with blank titles, unknown priorities, bad dates and minutes, and a category that isn't there."""
    from ..operators import cleaning

    i, text = F.col("id"), lambda c: F.col(c).cast("string")
    raw = views.tasks(spark, sf_dir).withColumns({
        "title": F.when(i % 7 == 0, " ").when(i % 41 == 0, F.repeat(F.lit("x"), F.lit(501))).otherwise(F.col("title")), "priority": F.when(i % 11 == 0, "asap").otherwise(F.col("priority")),
        "due_date": F.when(i % 23 == 0, "2020-13-01").when(i % 29 == 0, "1 May").otherwise(text("due_date")), "estimated_minutes": F.lit(None).cast("string"), "time_spent_minutes": F.when(i % 31 == 0, "-5").when(i % 37 == 0, "ten").otherwise(text("time_spent_minutes")),
    })
    known = spark.range(4).select(F.col("id").cast("int").alias("id"))
    return cleaning.violations(ops.with_known(raw, known), "id", ops.task_checks(known))


@query("""WITH have AS (SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand AS name FROM (SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0 AND p_brand < 'Brand#3')), want AS (SELECT lower(p_brand) AS low, min(p_brand) AS name FROM part WHERE p_brand > 'Brand#2' GROUP BY 1)
SELECT h.id, h.name, false AS created FROM have h JOIN want w ON lower(h.name) = w.low UNION ALL SELECT (SELECT coalesce(max(id), 0) FROM have) + row_number() OVER (ORDER BY low), name, true FROM want WHERE low NOT IN (SELECT lower(name) FROM have)""")
def tag_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some brands exist as tags; those that are asked for and aren't there become rows."""
    from ..operators.ranks import place

    p = parquet(spark, sf_dir, "part", ["p_partkey", "p_brand"])
    have = place(p.where("p_partkey % 2 = 0 AND p_brand < 'Brand#3'").select(F.col("p_brand").alias("name")).distinct(), ["name"], F.struct("name")).withColumnRenamed("place", "id")
    return ops.get_or_create(have, p.where("p_brand > 'Brand#2'").select(F.col("p_brand").alias("name")))
