"""Task lists: buckets, quadrants, sorts, counts, streaks, and changes as set-based updates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arith import half_up, percent
from .ranks import place, placed

SMART = ("all", "today", "upcoming", "important", "completed")
SORTS = ("custom", "due_asc", "due_desc", "priority", "title", "recent")
PRIORITIES, STATUSES = ("urgent", "high", "medium", "low"), ("todo", "in_progress", "completed")


def done() -> Column:
    return F.col("status") == "completed"


def overdue(today: Column) -> Column:
    return ~done() & F.coalesce(F.col("due_date") < today, F.lit(False))


def bucket(today: Column) -> Column:
    due = F.col("due_date")
    return F.when(done(), "completed").when(due.isNull(), "no_date").when(due < today, "overdue").when(due == today, "today").when(due == F.date_add(today, 1), "tomorrow").otherwise("upcoming")


def important() -> Column:
    return F.col("priority").isin("urgent", "high")


def quadrant(today: Column) -> Column:
    urgent = (F.col("priority") == "urgent") | F.coalesce(F.col("due_date") <= today, F.lit(False))
    return F.when(done(), F.lit(None)).when(urgent & important(), "do_first").when(important(), "schedule").when(urgent, "delegate").otherwise("eliminate")


def moved(target: str, today: Column) -> dict[str, Column]:
    """The priority and due date that put a task into a quadrant; a later due date stays."""
    due, pressing = F.col("due_date"), F.coalesce(F.col("due_date") <= today, F.lit(False))
    return {
        "do_first": {"priority": F.lit("urgent"), "due_date": today},
        "schedule": {"priority": F.lit("high"), "due_date": F.when(pressing, F.date_add(today, 1)).otherwise(due)},
        "delegate": {"priority": F.lit("medium"), "due_date": today},
        "eliminate": {"priority": F.lit("low"), "due_date": F.when(~pressing, due)},
    }[target]


def scope() -> Column:
    return F.when(F.col("deleted"), "trash").when(F.col("archived"), "archive").otherwise("active")


def in_list(name: str, today: Column) -> Column:
    due = F.col("due_date")
    found = {"today": due == today, "upcoming": due > F.date_add(today, 1), "important": important(), "completed": done()}
    return F.coalesce(found.get(name, F.lit(True)), F.lit(False))


def filtered(df: DataFrame, today: Column, scope_name: str = "active", smart: str = "all", category: int | None = None, text: str | None = None) -> DataFrame:
    """Scope, smart list, category and a part of title or description, all of them."""
    keep = (scope() == scope_name) & in_list(smart, today)
    if category is not None:
        keep = keep & (F.col("category_id") == category)
    if text:
        keep = keep & (F.lower("title").contains(text.lower()) | F.lower("description").contains(text.lower()))
    return df.where(keep)


def sort_key(name: str) -> Column:
    """The key, ascending, of one of the sort orders; pinned rows come first, and the id ends ties."""
    level = F.when(F.col("priority") == "urgent", 0).when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    own, i, late = F.col("order_index"), F.col("id"), F.col("due_date").isNull()
    keys = {"custom": [own, i], "due_asc": [late, F.col("due_date"), own, i], "due_desc": [late, -F.unix_date("due_date"), own, i], "priority": [level, own, i], "title": [F.lower("title"), i], "recent": [-F.unix_date("created_on"), -i]}
    return F.struct(~F.coalesce("pinned", F.lit(False)), *keys[name])


def sort_ranks(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df with the place of each row in the sort orders; ids are unique."""
    return placed(df, "id", {n: sort_key(n) for n in names})


def heat_level(completed: Column, created: Column) -> Column:
    return F.when(completed >= 4, 4).when(completed >= 2, 3).when(completed >= 1, 2).when(created >= 1, 1).otherwise(0)


def streaks(df: DataFrame, key: str, day: str, hit: str, today: str, days: int) -> DataFrame:
    """(key, streak): days with a hit in a row, back from today, within the window; a today without one doesn't end it."""
    back = F.date_diff(F.lit(today).cast("date"), F.col(day))
    active = df.groupBy(key, back.alias("back")).agg(F.max(hit).alias("hit"))
    found = active.groupBy(key).agg(F.collect_set(F.when(F.col("hit") & F.col("back").between(0, days - 1), F.col("back"))).alias("on"))
    gap = F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(days)), "on"))
    return found.select(key, (gap - 1 + F.array_contains("on", 0).cast("int")).cast("int").alias("streak"))


def headline(df: DataFrame, today: Column, streak: Column) -> DataFrame:
    """One row: total, completed, rate, overdue, minutes, hours and the index of the active tasks."""
    t = df.where(scope() == "active").agg(F.count("*").alias("total"), F.count_if(done()).alias("completed"), F.count_if(overdue(today)).alias("overdue"), F.coalesce(F.sum("time_spent_minutes"), F.lit(0)).alias("focus_minutes"))
    t = t.withColumns({"completion_rate": percent(F.col("completed"), F.col("total")), "focus_hours": half_up(F.col("focus_minutes") / 6) / 10})
    raw = half_up(F.col("completion_rate") * 0.7) + F.least(streak * 5, F.lit(20)) - F.least(F.col("overdue") * 10, F.lit(30)) + 20
    return t.withColumn("productivity_index", F.greatest(F.lit(10), F.least(F.lit(100), raw)).cast("long"))


def breakdown(df: DataFrame, column: str, values: list, none: str | None = None) -> DataFrame:
    """(value, total, completed, completion_pct, share_pct) of the active tasks; values without tasks stay, other values count as none."""
    spark = df.sparkSession
    active = df.where(scope() == "active").withColumn("value", F.col(column).cast("string"))
    if none:
        active = active.withColumn("value", F.when(F.col("value").isin([str(v) for v in values]), F.col("value")).otherwise(none))
    frame = spark.range(1).select(F.explode(F.array(*[F.lit(str(v)) for v in [*values, *([none] if none else [])]])).alias("value"))
    counts = frame.join(active.groupBy("value").agg(F.count("*").alias("total"), F.count_if(done()).alias("completed")), "value", "left").na.fill(0, ["total", "completed"])
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return counts.select("value", "total", "completed", percent(F.col("completed"), F.col("total")).alias("completion_pct"), percent(F.col("total"), whole).alias("share_pct"))


def month_grid(df: DataFrame, year: int, month: int, day: str) -> DataFrame:
    """(date, in_month, n): the whole weeks from Sunday on that touch a month, with the rows of each day."""
    first = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    start = F.date_sub(first, F.dayofweek(first) - 1)
    last = F.last_day(first)
    end = F.date_add(last, 7 - F.dayofweek(last))
    days = df.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("date"))
    counts = df.groupBy(F.col(day).alias("date")).agg(F.count("*").alias("n"))
    return days.join(counts, "date", "left").select("date", (F.month("date") == month).alias("in_month"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def bulk(df: DataFrame, changes: DataFrame, today: Column) -> DataFrame:
    """Tasks after changes (id, action, value), with changed; purged ones are gone, changes that change nothing are none."""
    out = df.join(changes.select("id", "action", "value"), "id", "left").where(~F.coalesce(F.col("action") == "purge", F.lit(False)))
    act = lambda name: F.coalesce(F.col("action") == name, F.lit(False))
    new = {
        "status": F.when(act("complete"), "completed").when(act("uncomplete") & done(), "todo").otherwise(F.col("status")),
        "completed_on": F.when(act("complete"), F.coalesce("completed_on", today)).when(~act("uncomplete"), F.col("completed_on")),
        "priority": F.when(act("priority"), F.col("value")).otherwise(F.col("priority")), "category_id": F.when(act("category"), F.col("value").cast("int")).otherwise(F.col("category_id")),
        "deleted": F.when(act("trash"), True).when(act("restore"), False).otherwise(F.col("deleted")), "archived": F.when(act("archive"), True).when(act("unarchive"), False).otherwise(F.col("archived")),
    }
    names = F.array_compact(F.array(*[F.when(~c.eqNullSafe(F.col(n)), F.lit(n)) for n, c in new.items()]))
    return out.withColumn("changed", names).select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], "changed")


def audit(changed: DataFrame, action: Column) -> DataFrame:
    """A row for each changed task with the names of the changed fields."""
    return changed.where(F.size("changed") > 0).select(F.col("id").alias("task_id"), F.col("title").alias("task_title"), action.alias("action"), F.concat_ws(", ", "changed").alias("details"))


def replay(log: DataFrame) -> DataFrame:
    """The latest state of each task from a change log (task_id, seq, status, flag), and when its present run of completion began.

    The stamp is set when a task becomes done, kept while it stays done, and cleared when it is reopened.
    """
    w = Window.partitionBy("task_id").orderBy("seq")
    is_done = F.col("status") == "completed"
    rows = log.withColumn("open_before", F.max(F.when(~is_done, F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = rows.groupBy("task_id").agg(F.max_by(F.struct("status", "flag", "open_before"), "seq").alias("l"), F.collect_list(F.when(is_done, F.col("seq"))).alias("done_at"), F.count("*").alias("changes"))
    began = F.array_min(F.filter("done_at", lambda s: s > F.coalesce(F.col("l.open_before"), F.lit(-1))))
    return last.select("task_id", F.col("l.status").alias("status"), F.col("l.flag").alias("flag"), F.when(F.col("l.status") == "completed", began).alias("completed_seq"), "changes")


def add_minutes(df: DataFrame, entries: DataFrame) -> DataFrame:
    """Logged minutes (id, minutes) added to tasks; entries outside 1 to 1440 and those of trashed tasks are refused."""
    total = entries.where(F.col("minutes").between(1, 1440)).groupBy("id").agg(F.sum("minutes").alias("more"))
    out = df.join(total, "id", "left")
    return out.withColumn("time_spent_minutes", F.col("time_spent_minutes") + F.when(F.col("deleted"), 0).otherwise(F.coalesce("more", F.lit(0)))).select(*df.columns)


def nested(tasks: DataFrame, subtasks: DataFrame, tags: DataFrame) -> DataFrame:
    """tasks with subtasks (structs position, id, completed, in that order), tags (names in order), done and total of the subtasks.

    subtasks: (task_id, position, id, completed); tags: (task_id, name). A task without any has empty arrays.
    """
    steps = subtasks.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "completed"))).alias("subtasks"))
    names = tags.groupBy("task_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    out = tasks.join(steps.withColumnRenamed("task_id", "step_of"), F.col("id") == F.col("step_of"), "left").join(names.withColumnRenamed("task_id", "tag_of"), F.col("id") == F.col("tag_of"), "left").drop("step_of", "tag_of")
    out = out.withColumns({"subtasks": F.coalesce("subtasks", F.array().cast(steps.schema["subtasks"].dataType)), "tags": F.coalesce("tags", F.array().cast("array<string>"))})
    return out.withColumns({"subtasks_done": F.size(F.filter("subtasks", lambda x: x["completed"])).cast("long"), "subtasks_total": F.size("subtasks").cast("long")})


def tagged(tasks: DataFrame, tags: DataFrame, name: str) -> DataFrame:
    """The tasks that carry a tag."""
    return tasks.join(tags.where(F.col("name") == name).select(F.col("task_id").alias("id")), "id", "left_semi")


def active_counts(owners: DataFrame, key: str, tasks: DataFrame) -> DataFrame:
    """owners with active: how many active tasks (key, ...) each has, 0 for none."""
    n = tasks.where(scope() == "active").groupBy(key).agg(F.count("*").alias("active"))
    return owners.join(n, key, "left").withColumn("active", F.coalesce("active", F.lit(0).cast("long")))


def moved_rows(tasks: DataFrame, moves: DataFrame, today: Column) -> DataFrame:
    """tasks after moves (id, column, place) to a status and place; a task that becomes completed gets the day, one that leaves completed loses it."""
    out = tasks.join(moves.select("id", "column", "place"), "id", "left")
    status = F.coalesce("column", "status")
    stamp = F.when(status != "completed", None).otherwise(F.coalesce("completed_on", today))
    new = {"status": status, "order_index": F.coalesce("place", "order_index"), "completed_on": F.when(F.col("column").isNull(), F.col("completed_on")).otherwise(stamp)}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in tasks.columns])


def without_categories(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """tasks whose category (of gone: category_id) is deleted stay, without a category."""
    lost = gone.select("category_id").distinct().withColumn("is_gone", F.lit(True))
    out = tasks.join(lost, "category_id", "left")
    return out.withColumn("category_id", F.when(F.col("is_gone").isNull(), F.col("category_id"))).select(*tasks.columns)


def patched(tasks: DataFrame, changes: DataFrame, fields: list[str], replace: bool = False) -> DataFrame:
    """tasks after changes (id, and the fields): a patch leaves a field as it is where the change has null, a replacement takes all fields as they come."""
    new = changes.select("id", F.lit(True).alias("is_changed"), *[F.col(f).alias(f"new_{f}") for f in fields])
    out = tasks.join(new, "id", "left")
    value = lambda f: F.when(F.col("is_changed"), F.col(f"new_{f}")).otherwise(F.col(f)) if replace else F.coalesce(f"new_{f}", f)
    return out.select(*[value(c).alias(c) if c in fields else F.col(c) for c in tasks.columns])


#: Fixed values.
MAX_TITLE, MAX_MINUTES = 500, 100_000


def task_checks(categories: DataFrame | None = None) -> list[tuple[str, str, Column]]:
    """What keeps a row of a task table with text columns from being taken: field, reason, condition. For cleaning.violations; a category must exist if known says so (see with_known)."""
    title, due = F.trim(F.coalesce(F.col("title"), F.lit(""))), F.col("due_date").cast("string")
    checks = [
        ("title", "required", title == ""), ("title", "too long", F.char_length(title) > MAX_TITLE),
        ("priority", "invalid", ~F.coalesce(F.col("priority").isin(*PRIORITIES), F.lit(False))), ("status", "invalid", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        ("due_date", "not YYYY-MM-DD", (F.coalesce(due, F.lit("")) != "") & (~F.coalesce(due.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(False)) | F.try_to_timestamp(due, F.lit("yyyy-MM-dd")).isNull())),
    ]
    for c in ("estimated_minutes", "time_spent_minutes"):
        number = F.col(c).cast("string").try_cast("long")
        checks.append((c, "not a whole number of minutes", (F.coalesce(F.col(c).cast("string"), F.lit("")) != "") & ~F.coalesce(number.between(0, MAX_MINUTES), F.lit(False))))
    return checks if categories is None else [*checks, ("category_id", "does not exist", F.col("category_id").isNotNull() & ~F.col("category_known"))]


def with_known(tasks: DataFrame, categories: DataFrame, key: str = "id") -> DataFrame:
    """tasks with category_known: whether the category is a row of categories."""
    have = categories.select(F.col(key).alias("known_id")).distinct()
    return tasks.join(have, tasks["category_id"] == have["known_id"], "left").withColumn("category_known", F.col("known_id").isNotNull()).drop("known_id")


def get_or_create(existing: DataFrame, wanted: DataFrame, name: str = "name") -> DataFrame:
    """(id, name, created): the existing rows that are wanted, and a new row for each other name (compared in lower case, its first spelling in order kept); new ids go on from the largest, by name."""
    have = existing.select("id", name, F.lower(name).alias("low"))
    asked = wanted.where(F.trim(name) != "").groupBy(F.lower(F.trim(name)).alias("low")).agg(F.min(F.trim(name)).alias(name))
    new = asked.join(have, "low", "left_anti")
    top = have.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    fresh = place(new, [name], F.struct("low")).crossJoin(F.broadcast(top)).select((F.col("top") + F.col("place")).alias("id"), name, F.lit(True).alias("created"))
    return have.join(asked.select("low"), "low", "left_semi").select("id", name, F.lit(False).alias("created")).unionByName(fresh)
