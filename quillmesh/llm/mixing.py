"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end; the source then repeats
from its start, LIMIT times at most. Golden-ratio points, mapped through the cumulative targets,
give each slot of the schedule a source; a slot's rank within its source names the block of words
that it takes. The points alone decide how many blocks a source gives: a few more or less than its
target holds, by their discrepancy, so blocks are short where a target is small. Blocks and the
documents they cut are joined.

No window or group holds a whole source: ranks are counted in chunks of slots and positions in
buckets of the hash, with sums of the chunks and buckets before. Points meet the sources' intervals
by a join on cells of the unit interval, so nothing that has an entry for each source is sent to
all tasks. Only the table of sources, a row for each, is put in order as a whole.

A word is a run of other characters than space, tab to carriage return. A null text has size 0;
a document of size 0 is never taken. A null source is a source of its own, the last in order.
Rows that repeat id, source and text share what is taken of them evenly, rounded down.
No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, let, table, whole, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words in a block, fewer where the smallest target has not FINE blocks.
BLOCK, FINE, CHUNK, BUCKET, CELLS = 1024, 256, 4096, 512, 4096
LIMIT = 3  # times a source's size
GOLDEN = 0.6180339887498949


def place(doc_id: Column, text: Column) -> Column:
    """60 bits of a hash: the shuffled order of a source's documents."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), whole(text))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """From (source, size): (sr, source, source_size, target, goal), weights 1, 2, 3 repeating in order of source.

    The targets share the sum of all sizes by weight; where LIMIT times the source's size is less,
    the target is that, and the rest is shared again: the level is the first at which no further
    source, in order of limit over weight, is above.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = each.withColumn("sr", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    each = each.withColumn("weight", (F.col("sr") - 1) % 3 + 1).withColumn("cap", LIMIT * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "sr")
    each = each.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = each.withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    each = each.withColumn("total", F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    each = each.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    whole_order = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = each.withColumn("place", F.row_number().over(order))
    each = each.withColumn("first", F.min(F.when(fits, F.struct("place", "level"))).over(whole_order)["level"])
    each = each.withColumn("target", F.least(F.coalesce("first", F.lit(0.0)) * F.col("weight"), F.col("cap").cast("double")))
    return each.select("sr", "source", "source_size", "total", "target", F.floor(F.col("target") + 0.5).cast("long").alias("goal"))


def schedule(sources: DataFrame, block: int, slots: int, total: int) -> DataFrame:
    """(slot, sr, rank): each slot's source, by the point that falls into the source's part of the unit interval, and the slot's rank there."""
    spark = sources.sparkSession
    ends = sources.withColumn("high", F.sum("goal").over(Window.orderBy("sr").rowsBetween(Window.unboundedPreceding, 0))).withColumn("low", F.col("high") - F.col("goal"))
    cell = lambda c: F.floor(F.col(c) * CELLS / F.lit(total))
    ends = ends.where("goal > 0").select("sr", "low", "high", F.explode(F.sequence(cell("low"), F.least(cell("high"), F.lit(CELLS - 1)))).alias("cell"))
    golden = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(slots).select(F.col("id").alias("slot"), ((golden - F.floor(golden)) * F.lit(total)).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * CELLS / F.lit(total))).join(ends, "cell").where("low <= x AND x < high").select("slot", "sr")
    points = points.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    chunks = points.groupBy("sr", "chunk").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy("sr").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("sr", "chunk", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("sr", "chunk").orderBy("slot")) - 1
    return points.withColumn("at", inner).join(chunks, ["sr", "chunk"]).select("slot", "sr", (F.col("base") + F.col("at")).alias("rank"))


def plan_size(sources: DataFrame) -> tuple[int, int, int]:
    """Words in a block, slots, and words of all targets."""
    total, least = sources.where("goal > 0").agg(F.sum("goal"), F.min("goal")).first()
    total, least = total or 0, least or 0
    block = max(1, min(BLOCK, least // FINE))
    return block, -(-total // block), total


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(id, source, size, h) of each document."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size"), place(F.col(id_col), text).alias("h"))


def pieces(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and the mix: (sr, h, size, n, copy, slot, at, first, words).

    Words first to first + words of a document (copy counts the n rows that share h and size) stand from
    place at in the block of the slot.
    """
    sources = written(targets(sizes), "sources")
    block, slots, total = plan_size(sources)
    plan = schedule(sources, block, slots, total)
    units = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).groupBy("sr", "source_size", "h", "size").agg(F.count("*").alias("n"))
    units = units.where("size > 0").withColumn("span", F.col("size") * F.col("n"))
    shift = max(0, 60 - max(0, (sizes.count() // BUCKET).bit_length()))
    units = units.withColumn("bucket", F.shiftright("h", shift))
    sums = units.groupBy("sr", "bucket").agg(F.sum("span").alias("words"))
    ahead = Window.partitionBy("sr").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sr", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("sr", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = units.withColumn("at", F.coalesce(F.sum("span").over(within), F.lit(0))).join(sums, ["sr", "bucket"]).withColumn("at", F.col("base") + F.col("at"))
    laid = laid.withColumn("at", F.explode(F.transform(F.sequence(F.lit(0), F.lit(LIMIT - 1)), lambda e: F.col("at") + e * F.col("source_size"))))
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    begin, end = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)
    cut = laid.select("sr", "h", "size", "n", "copy", F.col("at").alias("from"), F.explode(F.sequence(begin, end)).alias("rank"))
    start, left = F.col("rank") * block, F.greatest(F.col("from"), F.col("rank") * block)
    got = F.least(F.col("from") + F.col("size"), start + block) - left
    return sources, cut.join(plan, ["sr", "rank"]).select("sr", "h", "size", "n", "copy", "slot", (left - start).alias("at"), (left - F.col("from")).alias("first"), got.alias("words"))


def takes(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sources with their targets, and (sr, h, size, each, first_slot) for each distinct document: the words that the mix takes of each of its rows, and the first slot with any."""
    sources, laid = pieces(sizes)
    joined = laid.groupBy("sr", "h", "size", "n").agg(F.sum("words").alias("all"), F.min("slot").alias("first_slot"))
    return sources, joined.select("sr", "h", "size", F.floor(F.col("all") / F.col("n")).cast("long").alias("each"), "first_slot")


def named(docs: DataFrame, sources: DataFrame, columns: list[str], source_col: str, text_col: str, id_col: str) -> DataFrame:
    """docs with columns: size, source_size, target, place and rank of the source."""
    size, total, target, h, sr, name = columns
    s = sources.select(F.col("sr").alias(sr), F.col("source").alias(name), F.col("source_size").alias(total), F.col("target").alias(target))
    out = docs.withColumns({size: F.regexp_count(whole(F.col(text_col)), F.lit(WORD)).cast("long"), h: place(F.col(id_col), F.col(text_col))})
    return out.join(s, F.col(source_col).cast("string").eqNullSafe(F.col(name))).drop(name)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The columns of docs, and size, source_size, target, taken and first_slot (null where nothing is taken) for each document.

    Where docs has a column of such a name, the new one gets underscores in front.
    """
    size, total, target, taken, slot, h, sr, name, *other = fresh(docs, "size", "source_size", "target", "taken", "first_slot", "mix_place", "mix_rank", "mix_source", "took_rank", "took_place", "took_size")
    sources, took = takes(written(sized(docs, id_col, source_col, text_col), "sizes"))
    t = took.select(*[F.col(c).alias(n) for c, n in zip(("sr", "h", "size"), other, strict=True)], F.col("each").alias(taken), F.col("first_slot").alias(slot))
    out = named(docs, sources, [size, total, target, h, sr, name], source_col, text_col, id_col)
    out = out.join(t, (F.col(sr) == F.col(other[0])) & (F.col(h) == F.col(other[1])) & (F.col(size) == F.col(other[2])), "left")
    return out.withColumn(taken, F.coalesce(taken, F.lit(0).cast("long"))).select(*docs.columns, size, total, target, taken, slot)


def cut_text(text: Column, size: Column, spots: Column) -> Column:
    """spots, an array of structs (slot, at, first, words), with the text of each: its words and the white space between and behind them.

    The pieces of one pass over a text join to the whole of it.
    """
    words = F.when(F.exists(spots, lambda x: x["words"] < size), F.regexp_extract_all(text, F.lit(r"(?:^[\x20\x09-\x0D]+)?" + WORD + r"[\x20\x09-\x0D]*"), 0))

    def one(x: Column, w: Column) -> Column:
        part = F.when(x["words"] == size, text).otherwise(F.array_join(F.slice(w, (x["first"] + 1).cast("int"), x["words"].cast("int")), ""))
        return F.struct(*[x[c].alias(c) for c in ("slot", "at", "first", "words")], part.alias("text"))

    return let(words, lambda w: F.transform(spots, lambda x: one(x, w)))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that the mix takes: their columns, size, source_size, target, taken and pieces.

    pieces is an array of structs (slot, at, first, words, text) in order of slot: one for each block that holds
    a part of the document, as often as the mix repeats it. taken is the sum of the words; over a source
    that is near its target. Of rows that repeat id, source and text each has the pieces of one copy.
    """
    size, total, target, taken, spots, h, sr, name, copy, *other = fresh(docs, "size", "source_size", "target", "taken", "pieces", "mix_place", "mix_rank", "mix_source", "mix_copy", "took_rank", "took_place", "took_size", "took_copy", "took_spots")
    sources, laid = pieces(written(sized(docs, id_col, source_col, text_col), "sizes"))
    t = laid.groupBy("sr", "h", "size", "copy").agg(F.sort_array(F.collect_list(F.struct("slot", "at", "first", "words"))).alias("spots"), F.sum("words").alias("sum"))
    t = t.select(*[F.col(c).alias(n) for c, n in zip(("sr", "h", "size", "copy", "spots"), other, strict=True)], F.col("sum").alias(taken))
    out = named(docs, sources, [size, total, target, h, sr, name], source_col, text_col, id_col).where(F.col(size) > 0)
    out = out.withColumn(copy, F.row_number().over(Window.partitionBy(sr, h, size).orderBy(h)) - 1)
    out = out.join(t, (F.col(sr) == F.col(other[0])) & (F.col(h) == F.col(other[1])) & (F.col(size) == F.col(other[2])) & (F.col(copy) == F.col(other[3])))
    return out.select(*docs.columns, size, total, target, taken, cut_text(whole(F.col(text_col)), F.col(size), F.col(other[4])).alias(spots))


def blocks(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(slot, at, id, source, first, words, text): the mix, a row for each piece; by slot and at, it is the mixed corpus in its order."""
    rows = mixed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "id")
    rows = rows.select("id", "source", F.explode("pieces").alias("x"))
    return rows.select("x.slot", "x.at", "id", "source", "x.first", "x.words", "x.text")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "sizes")
    sources, took = takes(sizes)
    s = sources.withColumnRenamed("source", "name").select("sr", "name", "source_size", "target")
    rows = sizes.join(s, sizes["source"].eqNullSafe(s["name"])).join(took, ["sr", "h", "size"], "left")
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("each", F.lit(0).cast("long")).alias("taken"), "first_slot")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sr FROM d GROUP BY source
), w AS (
  SELECT *, (sr - 1) % 3 + 1 AS weight, 3 * source_size AS cap, (sum(source_size) OVER ())::bigint AS total FROM s
), l AS (
  SELECT *, ((total - coalesce(sum(cap) OVER (ORDER BY cap / weight, sr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint
      / (sum(weight) OVER (ORDER BY cap / weight, sr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::bigint) AS level
  FROM w
), f AS (SELECT coalesce(arg_min(level, (cap / weight, sr)), 0) AS level FROM l WHERE level * weight <= cap
), t AS (
  SELECT sr, source, source_size, least(f.level * weight, cap::double) AS target, floor(least(f.level * weight, cap::double) + 0.5)::bigint AS goal FROM l, f
), z AS (
  SELECT sum(goal)::bigint AS total, greatest(1, least(1024, min(goal) // 256))::bigint AS block FROM t WHERE goal > 0
), i AS (
  SELECT sr, (sum(goal) OVER (ORDER BY sr))::bigint AS high, (sum(goal) OVER (ORDER BY sr))::bigint - goal AS low FROM t
), x AS (
  SELECT slot, ((slot + 0.5::double) * 0.6180339887498949::double - floor((slot + 0.5::double) * 0.6180339887498949::double)) * z.total AS x
  FROM z, unnest(range(0, (z.total + z.block - 1) // z.block)) AS r(slot)
), r AS (
  SELECT slot, sr, row_number() OVER (PARTITION BY sr ORDER BY slot) - 1 AS rank FROM x JOIN i ON i.low <= x.x AND x.x < i.high
), g AS (SELECT sr, count(*) * any_value(z.block) AS got FROM r, z GROUP BY sr
), u AS (
  SELECT t.sr, h, size, count(*) AS n, any_value(source_size) AS source_size
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0 GROUP BY t.sr, h, size
), p AS (
  SELECT *, (coalesce(sum(size * n) OVER (PARTITION BY sr ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint AS pos FROM u
), k AS (
  SELECT p.sr, h, size, pos // z.block AS rank,
    (greatest(0, least(size * n, got - pos)) + greatest(0, least(size * n, got - pos - source_size)) + greatest(0, least(size * n, got - pos - 2 * source_size))) // n AS each
  FROM p JOIN g ON g.sr = p.sr CROSS JOIN z
)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(k.each, 0)::bigint AS taken, r.slot AS first_slot
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN k ON k.sr = t.sr AND k.h = d.h AND k.size = d.size LEFT JOIN r ON r.sr = k.sr AND r.rank = k.rank
"""
