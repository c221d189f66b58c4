"""Corpus preparation: folds with leakage removal, windows, mixtures, character statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cleaning import md5_order


def first_by_key(df: DataFrame, key: Column, precedence: Column, order: str) -> DataFrame:
    """The first row of each key, by precedence and order; the bound on row_number is applied before the shuffle too."""
    w = Window.partitionBy("dedup_key").orderBy("dedup_precedence", order)
    rows = df.withColumns({"dedup_key": F.md5(key), "dedup_precedence": precedence})
    return rows.withColumn("dedup_n", F.row_number().over(w)).where("dedup_n = 1").drop("dedup_n", "dedup_key", "dedup_precedence")


def without_leaks(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    return train.join(held.select(key).distinct(), key, "left_anti")


def sharing_groups(turns: DataFrame, group: str, key: str, held: Column) -> DataFrame:
    """Groups that aren't held out and share a key with one that is."""
    other = turns.where(held).select(key).distinct()
    return turns.where(~held).join(other, key, "left_semi").select(group).distinct()


def trimmed(turns: DataFrame, group: str, turn: str, role: str, last: str = "assistant") -> DataFrame:
    """Turns up to each group's last one of a role; later ones have no answer."""
    end = turns.withColumn("trim_end", F.max(F.when(F.col(role) == last, F.col(turn))).over(Window.partitionBy(group)))
    return end.where(F.col(turn) <= F.col("trim_end")).drop("trim_end")


def chunks(df: DataFrame, key: str, size: Column, budget: int, prefix: int, overlap: int) -> DataFrame:
    """(key, piece, start, stop, context): windows of at most budget characters, each with room for a prefix.

    Every character is a target of exactly one window; later windows repeat overlap characters
    before their start as context that is no target.
    """
    room, step = budget - prefix, budget - prefix - overlap
    count = F.when(size <= room, 1).otherwise(1 + F.ceil((size - room) / step))
    out = df.select(key, size.alias("chunk_size"), F.explode(F.sequence(F.lit(0), count.cast("int") - 1)).alias("piece"))
    start = F.when(F.col("piece") == 0, 0).otherwise(room + (F.col("piece") - 1) * step)
    stop = F.least(F.col("chunk_size"), F.lit(room) + F.col("piece") * step)
    return out.select(key, "piece", start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.when(F.col("piece") == 0, 0).otherwise(overlap).alias("context"))


def turn_windows(turns: DataFrame, group: str, turn: str, role: str, size: Column, budget: int, overlap: int) -> DataFrame:
    """(group, exchange, first_turn, kind, window, pieces): exchanges (a user's turn and what follows it) packed into windows of at most budget.

    Each window opens with the turns before the first user's turn again. An exchange goes into the
    window of the one before if it fits, else into a new one (kind packed). One that is too long by
    itself is cut (chunked): each of its pieces is a window that opens with the user's turn too and
    repeats overlap of the reply as context, so every character of a reply is a target once. An
    exchange whose opening leaves no room for more than the overlap is dropped: window is null,
    pieces 0. Conversations without a user's turn have no row.
    """
    rows = turns.select(group, turn, (F.col(role) == "user").alias("asks"), size.alias("n"))
    rows = rows.withColumn("exchange", F.sum(F.col("asks").cast("int")).over(Window.partitionBy(group).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    each = rows.groupBy(group, "exchange").agg(F.min(turn).alias("first"), F.sum(F.when(F.col("asks"), F.col("n")).otherwise(0)).alias("ask"), F.sum("n").alias("all"))
    whole = each.groupBy(group).agg(F.coalesce(F.max(F.when(F.col("exchange") == 0, F.col("all"))), F.lit(0)).alias("opening"), F.array_sort(F.collect_list(F.when(F.col("exchange") > 0, F.struct("exchange", "first", "ask", "all")))).alias("es"))
    room = F.lit(budget) - F.col("opening")
    kind = "struct<exchange:int,first:bigint,kind:string,window:int,pieces:int>"
    start = F.struct(F.lit(0).alias("opened"), F.lit(budget + 1).cast("long").alias("used"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        fits, goes_on = e["all"] <= room, acc["used"] + e["all"] <= room
        left = room - e["ask"]
        pieces = F.when(fits, 1).when(left > overlap, 1 + F.ceil((e["all"] - e["ask"] - left) / (left - overlap))).otherwise(0).cast("int")
        opened = F.when(fits & goes_on, acc["opened"]).otherwise(acc["opened"] + pieces)
        window = F.when(fits, opened - 1).when(pieces > 0, acc["opened"])
        row = F.struct(e["exchange"].alias("exchange"), e["first"].cast("long").alias("first"), F.when(fits, "packed").when(pieces > 0, "chunked").otherwise("dropped").alias("kind"), window.cast("int").alias("window"), pieces.alias("pieces"))
        used = F.when(fits & goes_on, acc["used"] + e["all"]).when(fits, e["all"]).when(pieces > 0, budget + 1).otherwise(acc["used"]).cast("long")
        return F.struct(opened.cast("int").alias("opened"), used.alias("used"), F.concat(acc["out"], F.array(row)).alias("out"))

    packed = whole.select(group, F.explode(F.aggregate("es", start, step, lambda acc: acc["out"])).alias("x"))
    return packed.select(group, "x.exchange", F.col("x.first").alias("first_turn"), "x.kind", "x.window", "x.pieces")


def fitted(turns: DataFrame, group: str, turn: str, role: str, size: Column, budget: int) -> DataFrame:
    """(group, kept, dropped, fits): the oldest exchanges go until the rest fits; an exchange begins at a user's turn."""
    back = Window.partitionBy(group).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns({"run": F.sum(size).over(back), "begins": F.col(role) == "user"})
    cut = rows.groupBy(group).agg(F.count("*").alias("turns"), F.min(F.when(F.col("begins") & (F.col("run") <= budget), F.col(turn))).alias("first"), F.max(turn).alias("last"), F.collect_list(turn).alias("all"))
    kept = F.when(F.col("first").isNull(), 0).otherwise(F.size(F.filter("all", lambda t: t >= F.col("first"))))
    return cut.select(group, kept.cast("long").alias("kept"), (F.col("turns") - kept).alias("dropped"), F.col("first").isNotNull().alias("fits"))


def mixture(sizes: DataFrame, repeats: Column) -> DataFrame:
    """(source, repeats, tokens, effective, share) from (source, tokens)."""
    every = Window.partitionBy(F.lit(1))
    t = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).withColumn("repeats", repeats)
    t = t.withColumn("effective", F.col("tokens") * F.col("repeats"))
    return t.select("source", "repeats", "tokens", "effective", F.round(F.col("effective") / F.sum("effective").over(every), 6).alias("share"))


def repeated(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as times says, with the number of the pass."""
    return df.withColumn("pass", F.explode(F.sequence(F.lit(1), times)))


def dealt(df: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """role: of each group one row is val, one test, the rest train, by md5 order."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(md5_order(F.col(key), seed), key))
    return df.withColumn("role", F.when(n == 1, "val").when(n == 2, "test").otherwise("train"))


def letters(df: DataFrame, text: Column) -> DataFrame:
    """(token, n): characters of all texts."""
    return df.select(F.explode(F.split(text, "(?s)(?<=.)(?=.)")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def unigram_loss(train: DataFrame, held: DataFrame, vocabulary: int) -> DataFrame:
    """One row: cross-entropy in nats and perplexity of add-one smoothed counts (token, n) on held-out counts."""
    total = train.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    j = held.select("token", F.col("n").alias("m")).join(train, "token", "left").crossJoin(F.broadcast(total))  # one row
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.col("total") + vocabulary)
    return j.agg((-F.sum(F.col("m") * F.log(p)) / F.sum("m")).alias("loss")).select(F.round("loss", 6).alias("loss"), F.round(F.exp(F.least("loss", F.lit(20.0))), 4).alias("perplexity"))


def repetition(df: DataFrame, key: str, text: Column, n: int = 12) -> DataFrame:
    """(key, grams, most, distinct_ratio, looping) of each row whose text has n characters: how often its most frequent n characters in a row occur. They are counted by hash within the row, so nothing is shuffled."""
    rows = df.select(key, text.cast("string").alias("t")).where(F.length("t") >= n)

    def counted(texts: pd.Series) -> pd.DataFrame:
        found = []
        for t in texts:
            codes = np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
            h = np.zeros(len(codes) - n + 1, dtype=np.uint64)
            for i in range(n):
                h = (h ^ codes[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            times = np.unique(h, return_counts=True)[1]
            found.append((int(len(h)), int(times.max()), int(len(times))))
        return pd.DataFrame(found, columns=["grams", "most", "different"])

    out = rows.select(key, F.pandas_udf(counted, "grams long, most long, different long")("t").alias("c"))
    return out.select(key, "c.grams", "c.most", F.round(F.col("c.different") / F.col("c.grams"), 6).alias("distinct_ratio"), (F.col("c.most") >= 3).alias("looping"))


def epochs(df: DataFrame, key: str, factor: Column, count: int, seed: str) -> DataFrame:
    """(epoch, pass) and df: in each epoch a row of a factor of 1 or more stands that often, and of a smaller factor that share of the rows, chosen anew by a hash with the epoch in it."""
    each = df.withColumns({"factor_": factor.cast("double"), "epoch": F.explode(F.sequence(F.lit(0), F.lit(count - 1)))})
    bucket = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "epoch", F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 1000
    times = F.when(F.col("factor_") >= 1, F.floor("factor_")).otherwise((bucket < F.col("factor_") * 1000).cast("long"))
    return each.withColumn("times_", times).where("times_ > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times_")))).drop("times_", "factor_")


def folded(turns: DataFrame, key: str, order: list[str], fields: list[str], name: str = "messages") -> DataFrame:
    """(key, messages): the rows of each key as an array of structs, in order."""
    at = F.array_sort(F.collect_list(F.struct(*order, *[F.col(f).alias(f"{f}_") for f in fields])))
    return turns.groupBy(key).agg(F.transform(at, lambda x: F.struct(*[x[f"{f}_"].alias(f) for f in fields])).alias(name))


def unfolded(df: DataFrame, key: str, name: str = "messages") -> DataFrame:
    """(key, place, and the fields) of each struct of an array, in order, place from 0; a null or empty array has no rows."""
    return df.select(key, F.posexplode(name).alias("place", "m")).select(key, "place", "m.*")
