"""Quick-capture text: priority, tags, minutes, due date and title out of one line, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arith import half_up

# Words for priorities, names of days, and the tokens of the notation.
PRIORITY_WORDS = {"urgent": "urgent", "crit": "urgent", "critical": "urgent", "u": "urgent", "high": "high", "h": "high", "important": "high", "medium": "medium", "med": "medium", "m": "medium", "normal": "medium", "low": "low", "l": "low"}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
TAG = r"(?<!\S)#([A-Za-z0-9_-]+)"
PRIORITY = r"(?<!\S)!([A-Za-z0-9_]+)"
ESTIMATE = r"(?i)(?<!\S)~(\d+(?:\.\d+)?|\.\d+)(hrs|hr|h|mins|min|m)?(?![\w.])"
DUE = r"(?<!\S)@(\S+?)(?=[.,;:!?)\]]*(?:\s|$))"


def tags(text: Column) -> Column:
    """Distinct tags in lower case, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TAG), 1), lambda x: F.lower(x)))


def without_first(text: Column, pattern: str) -> Column:
    at = F.regexp_instr(text, F.lit(pattern))
    found = F.regexp_extract(text, pattern, 0)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(found), F.length(text)))).otherwise(text)


def priority(text: Column) -> Column:
    words = F.create_map(*[F.lit(x) for pair in PRIORITY_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(words, F.lower(F.regexp_extract(text, PRIORITY, 1))), F.lit("medium"))


def minutes(text: Column) -> Column:
    """Minutes of an estimate; hours count sixty; null without one."""
    amount, unit = F.regexp_extract(text, ESTIMATE, 1), F.lower(F.regexp_extract(text, ESTIMATE, 2))
    value = F.when(amount != "", amount.cast("double"))
    return half_up(F.when(unit.isin("h", "hr", "hrs"), value * 60).otherwise(value))


def due(value: Column, today: Column) -> Column:
    """today, tomorrow, yesterday, nextweek, the next day of a name (strictly later), or a date; else null."""
    v = F.lower(value)
    out = F.when(v.isin("today", "tod"), today).when(v.isin("tomorrow", "tom"), F.date_add(today, 1)).when(v == "yesterday", F.date_sub(today, 1)).when(v == "nextweek", F.date_add(today, 7))
    for name in DAYS:
        out = out.when(v.isin(name, name[:3]), F.next_day(today, name[:3]))
    return out.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(v, "yyyy-MM-dd"))


def capture(text: Column, today: Column) -> Column:
    """struct<title, priority, tags, minutes, due>: the tokens go, the rest is the title."""
    text = F.coalesce(text, F.lit(""))
    bare = F.regexp_replace(text, TAG, " ")
    rest = without_first(without_first(without_first(bare, PRIORITY), ESTIMATE), DUE)
    title = F.trim(F.regexp_replace(rest, r"\s+", " "))
    return F.struct(title.alias("title"), priority(bare).alias("priority"), tags(text).alias("tags"), minutes(without_first(bare, PRIORITY)).alias("minutes"), due(F.regexp_extract(without_first(without_first(bare, PRIORITY), ESTIMATE), DUE, 1), today).alias("due"))


def tag_name(text: Column) -> Column:
    """A tag as it is stored: no spaces or leading signs, lower case, null if empty or over 30 long."""
    name = F.lower(F.regexp_replace(F.trim(text), r"^#+", ""))
    return F.when(F.length(name).between(1, 30), name)
