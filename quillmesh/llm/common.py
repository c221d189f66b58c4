"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A control character that no span pattern matches, and what stands in for it in a text.
MARK, STAND_IN = "\u0001", "\u0002"
_homes: set[str] = set()
#: Pieces of a text that are put in place in one go.
RUN = 512


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session may leave it unset; a cluster without it is an error, because a
    machine-local folder would lose data there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "/tmp/checkpoints/quillmesh"


def _home(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver's process ends."""
    home = f"{shared_root(spark)}/quillmesh-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(lambda: _delete(jvm, conf, home))
    return home


def _delete(jvm, conf, path: str) -> None:
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have gone first
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage durably."""
    path = f"{_home(df.sparkSession)}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Remove the files of a written table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), folder)


def released(spark: SparkSession) -> None:
    """Let go of the plans, broadcasts and shuffles of DataFrames that nothing uses any more.

    The session's cleaner removes these only once they are collected, in Python first, then in the
    JVM; a driver with memory to spare may not do so for a long time, and keeps a larger heap.
    """
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if its scan has fewer tasks than the cluster has cores: a small file of one row group. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df doesn't have."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: two independent 64-bit hashes, as one string."""
    return F.md5(whole(text))


def fold_bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 marks the held-out fold. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at the leftmost non-overlapping matches: between, match, between, match, ..., between.

    The mark can't be in a match, so a mark in the text is replaced by another control
    character first; lengths stay as they are.
    """
    safe = F.when(F.instr(text, MARK) > 0, F.translate(text, MARK, STAND_IN)).otherwise(text)
    return F.split(F.regexp_replace(safe, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once although body uses it several times or in a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def spans(text: Column, pattern: str, context: int = 0, gate: str | None = None) -> Column:
    """array<struct<s,e,m[,l,r]>>: start and end in code points, the match, and what stands left and right of it.

    gate: a cheaper pattern that every text with a match holds; other texts are done with it.
    """

    def cut(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            fields = [F.char_length(p).alias("n"), F.when(i % 2 == 1, p).alias("m")]
            if context:
                fields += [
                    F.when(i % 2 == 1, F.right(F.get(parts, i - 1), F.lit(context))).alias("l"),
                    F.when(i % 2 == 1, F.left(F.get(parts, i + 1), F.lit(context))).alias("r"),
                ]
            return F.struct(*fields)

        return F.transform(parts, one)

    more = ", l: string, r: string" if context else ""
    kind = f"array<struct<s: int, e: int, m: string{more}>>"

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        found = [acc["at"].alias("s"), (acc["at"] + p["n"]).alias("e"), p["m"].alias("m")]
        found += [p[c].alias(c) for c in ("l", "r")] if context else []
        return F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(*found)))).alias("out"),
        )

    def located(parts: Column) -> Column:
        """A growing array is copied at each step, so long ones are built in runs of RUN."""
        few = F.aggregate(parts, start(F.lit(0)), step, lambda acc: acc["out"])
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / RUN).cast("int")), lambda i: F.slice(parts, i * RUN + 1, F.lit(RUN)))
        length = lambda run: F.aggregate(run, F.lit(0), lambda a, p: a + p["n"])
        ends = lambda rs: F.aggregate(rs, F.array(F.lit(0)), lambda a, run: F.concat(a, F.array(F.element_at(a, -1) + length(run))))
        many = let(runs, lambda rs: let(ends(rs), lambda at: F.flatten(F.transform(rs, lambda run, i: F.aggregate(run, start(F.get(at, i)), step, lambda acc: acc["out"])))))
        return F.when(F.size(parts) <= RUN, few).otherwise(many)

    found = let(pieces(text, pattern), lambda parts: let(cut(parts), located))
    return F.when(text.rlike(gate), found).otherwise(F.array().cast(kind)) if gate else found


def span_text(found: Column) -> Column:
    """kind:start:end of an array of structs (kind, s, e), comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def marks(hashes: DataFrame, bits: int) -> DataFrame:
    """(word, set): the words of a bitmap of the hashes h that have a bit set; bits / 64 rows at most."""
    slot = F.pmod(F.col("h"), F.lit(bits))
    at = hashes.select(F.shiftright(slot, 6).alias("word"), (slot % 64).cast("int").alias("bit")).distinct()
    return at.groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))


def marked(df: DataFrame, hash_of: Column, words: DataFrame, bits: int, name: str) -> DataFrame:
    """df with a boolean: whether the hash's bit is set. words is broadcast; it has bits / 64 rows at most."""
    w, b = fresh(df, "mark_word", "mark_set")
    slot = F.pmod(hash_of, F.lit(bits))
    out = df.join(F.broadcast(words.select(F.col("word").alias(w), F.col("set").alias(b))), F.shiftright(slot, 6) == F.col(w), "left")
    return out.withColumn(name, F.coalesce(F.getbit(F.col(b), (slot % 64).cast("int")) == 1, F.lit(False))).drop(w, b)


def bitmap(hashes: DataFrame, bits: int) -> Column:
    """A scalar array of bits/64 longs with the bit of each hash set; column name h."""
    spark = hashes.sparkSession
    slot = F.pmod(F.col("h"), F.lit(bits))
    filled = hashes.select(slot.alias("slot"))
    filled = filled.distinct().select(F.shiftright("slot", 6).alias("word"), F.expr("shiftleft(1L, cast(slot % 64 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("set"))
    every = spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit")).unionByName(filled.select("word", F.col("set").alias("bit"))).groupBy("word").agg(F.bit_or("bit").alias("set"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "set"))), lambda x: x["set"]).alias("a")).scalar()


def has(bits: Column, size: int, h: Column) -> Column:
    slot = F.pmod(h, F.lit(size))
    return F.getbit(F.get(bits, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1
