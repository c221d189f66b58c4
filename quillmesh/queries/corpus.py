"""Corpus preparation on documents, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import cleaning
from ..operators import corpus as ops
from ..sources.tables import parquet
from .registry import query

KEY = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
ROLE = "CASE WHEN doc_id % 20 = 0 THEN 'test' WHEN doc_id % 20 = 1 THEN 'val' ELSE 'train' END"
PRECEDENCE = "CASE WHEN doc_id % 20 = 0 THEN 0 WHEN doc_id % 20 = 1 THEN 1 ELSE 2 END"
KEPT = f"WITH kept AS (SELECT doc_id, text, lang, source, {ROLE} AS role, {KEY} AS key FROM documents QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {PRECEDENCE}, doc_id) = 1)"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return parquet(spark, sf_dir, "documents", list(columns))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    part = F.when(F.col("doc_id") % 20 == 0, 0).when(F.col("doc_id") % 20 == 1, 1).otherwise(2)
    role = F.when(part == 0, "test").when(part == 1, "val").otherwise("train")
    return ops.first_by_key(d, tx.normal_key(F.col("text")), part, "doc_id").withColumn("role", role)


@query(f"{KEPT} SELECT doc_id, role FROM kept")
def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("doc_id", "role")


@query(f"SELECT doc_id, md5({KEY}) AS key FROM documents")
def corpus_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(tx.normal_key(F.col("text"))).alias("key"))


@query(f"WITH l AS (SELECT doc_id, {ROLE} AS role, unnest(string_split(text, chr(10))) AS text FROM documents), h AS (SELECT DISTINCT {KEY} AS key FROM l WHERE role <> 'train' AND length(text) >= 40) SELECT DISTINCT doc_id FROM l WHERE role = 'train' AND {KEY} IN (SELECT key FROM h)")
def corpus_sharing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training documents that share a line of 40 characters or more with a held-out one."""
    d = documents(spark, sf_dir, "doc_id", "text")
    lines = d.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("key", F.md5(tx.normal_key(F.col("line"))))
    held = F.col("doc_id") % 20 < 2
    long = F.length("line") >= 40
    other = lines.where(held & long).select("key").distinct()
    return lines.where(~held).join(other, "key", "left_semi").select("doc_id").distinct()


@query(f"{KEPT}, b AS (SELECT DISTINCT {KEY} AS key FROM benchmark) SELECT doc_id FROM kept WHERE role = 'train' AND key NOT IN (SELECT key FROM b)")
def corpus_without_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = parquet(spark, sf_dir, "benchmark", ["text"]).select(F.md5(tx.normal_key(F.col("text"))).alias("key"))
    train = kept(spark, sf_dir).where("role = 'train'").withColumn("key", F.md5(tx.normal_key(F.col("text"))))
    return ops.without_leaks(train, held, "key").select("doc_id")


FOLD = "translate(translate(text, '‘’“”–—…·×' || chr(160), '''''\"\"--..x '), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyAAAAAACEEEEIIIINOOOOOUUUUY')"


@query(f"SELECT lang, source, count(*) AS examples, sum(length(text))::bigint AS chars, sum(len(regexp_extract_all({FOLD}, '[^\\x09\\x0A\\x20-\\x7E]')))::bigint AS replaced, round(sum(len(regexp_extract_all({FOLD}, '[^\\x09\\x0A\\x20-\\x7E]'))) / sum(length(text)), 6) AS rate FROM documents GROUP BY ALL")
def corpus_character_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text", "lang", "source").withColumn("r", tx.replaced(F.col("text")))
    return d.groupBy("lang", "source").agg(F.count("*").alias("examples"), F.sum(F.length("text")).alias("chars"), F.sum("r").alias("replaced"), F.round(F.sum("r") / F.sum(F.length("text")), 6).alias("rate"))


@query(f"SELECT doc_id, md5(regexp_replace({FOLD}, '[^\\x09\\x0A\\x20-\\x7E]', ' ', 'g')) AS folded FROM documents")
def corpus_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.md5(tx.folded(F.col("text"))).alias("folded"))


ENC = "list_transform(string_split(text, ''), lambda c: CASE WHEN c = chr(10) THEN 99 WHEN c = chr(9) THEN 100 WHEN unicode(c) BETWEEN 32 AND 126 THEN unicode(c) - 28 ELSE 4 END)"


@query(f"SELECT conv_id, turn, array_to_string({ENC}, ' ') AS ids, regexp_replace(text, '[^\\x09\\x0A\\x20-\\x7E]', ' ', 'g') AS back FROM conversations")
def corpus_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).withColumn("ids", tx.encoded(F.col("text")))
    return c.select("conv_id", "turn", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), tx.decoded(F.col("ids")).alias("back"))


@query("SELECT conv_id, '<system>Be brief.<end>' || string_agg('<' || role || '>' || text || '<end>', '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def corpus_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", tx.rendered(F.col("turns"), F.lit("Be brief.")).alias("rendered"))


@query("WITH e AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS stop FROM conversations GROUP BY 1) SELECT c.conv_id, count(*) AS turns, sum(length(text))::bigint AS chars FROM conversations c JOIN e ON c.conv_id = e.conv_id AND turn <= stop GROUP BY c.conv_id")
def corpus_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return ops.trimmed(c, "conv_id", "turn", "role").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@query("""WITH s AS (SELECT doc_id, length(text) AS size FROM documents), c AS (SELECT *, CASE WHEN size <= 448 THEN 1 ELSE 1 + ceil((size - 448) / 384.0::double)::int END AS n FROM s), w AS (SELECT *, unnest(range(0, n)) AS piece FROM c)
SELECT doc_id, piece::int AS piece, (CASE WHEN piece = 0 THEN 0 ELSE 448 + (piece - 1) * 384 END)::bigint AS start, least(size, 448 + piece * 384)::bigint AS stop, (CASE WHEN piece = 0 THEN 0 ELSE 64 END)::int AS context FROM w""")
def corpus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chunks(documents(spark, sf_dir, "doc_id", "text"), "doc_id", F.length("text"), 512, 64, 64)


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn, role, length(text) AS n, (sum((role = 'user')::int) OVER (PARTITION BY conv_id ORDER BY turn))::int AS exchange FROM conversations),
e AS (SELECT conv_id, exchange, min(turn) AS first_turn, coalesce(sum(n) FILTER (WHERE role = 'user'), 0)::bigint AS ask, sum(n)::bigint AS whole FROM n GROUP BY ALL),
o AS (SELECT e.*, 400 - coalesce((SELECT whole FROM e f WHERE f.conv_id = e.conv_id AND f.exchange = 0), 0) AS room FROM e WHERE exchange > 0),
w AS (
  SELECT conv_id, 0 AS exchange, NULL::bigint AS first_turn, NULL::varchar AS kind, NULL::int AS win, 0 AS pieces, 0 AS opened, 0::bigint AS free FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL
  SELECT o.conv_id, o.exchange, o.first_turn,
    CASE WHEN whole <= room THEN 'packed' WHEN room - ask > 64 THEN 'chunked' ELSE 'dropped' END,
    CASE WHEN whole <= room AND opened > 0 AND whole <= free THEN opened - 1 WHEN whole <= room OR room - ask > 64 THEN opened END,
    CASE WHEN whole <= room THEN 1 WHEN room - ask > 64 THEN 1 + ceil((whole - room)::double / (room - ask - 64))::int ELSE 0 END,
    CASE WHEN whole <= room AND opened > 0 AND whole <= free THEN opened WHEN whole <= room THEN opened + 1 WHEN room - ask > 64 THEN opened + 1 + ceil((whole - room)::double / (room - ask - 64))::int ELSE opened END,
    CASE WHEN whole <= room AND opened > 0 AND whole <= free THEN free - whole WHEN whole <= room THEN room - whole WHEN room - ask > 64 THEN -1 ELSE free END
  FROM w JOIN o ON o.conv_id = w.conv_id AND o.exchange = w.exchange + 1)
SELECT conv_id, exchange, first_turn, kind, win AS window, pieces FROM w WHERE exchange > 0""")
def corpus_turn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return ops.turn_windows(c, "conv_id", "turn", "role", F.length("text"), 400, 64)


@query("""WITH r AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS run FROM conversations), f AS (SELECT conv_id, count(*) AS n, min(turn) FILTER (WHERE role = 'user' AND run <= 600) AS first FROM r GROUP BY 1)
SELECT f.conv_id, count(c.turn) AS kept, any_value(n) - count(c.turn) AS dropped, any_value(first) IS NOT NULL AS fits FROM f LEFT JOIN conversations c ON c.conv_id = f.conv_id AND c.turn >= first GROUP BY f.conv_id""")
def corpus_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return ops.fitted(c, "conv_id", "turn", "role", F.length("text"), 600)


@query("""WITH u AS (SELECT conv_id, min(turn) FILTER (WHERE role = 'user' AND length(text) >= 20) AS u FROM conversations GROUP BY 1), a AS (SELECT u.conv_id, u, min(turn) AS a FROM u JOIN conversations c ON c.conv_id = u.conv_id AND turn > u AND role = 'assistant' GROUP BY ALL)
SELECT a.conv_id, (SELECT count(*) FROM conversations c WHERE c.conv_id = a.conv_id AND turn < u) AS history, md5(m.text) AS message, md5(r.text) AS reference FROM a JOIN conversations m ON m.conv_id = a.conv_id AND m.turn = u JOIN conversations r ON r.conv_id = a.conv_id AND r.turn = a.a""")
def corpus_first_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    t = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = t.withColumn("m", F.get(F.filter("t", lambda x: (x["role"] == "user") & (F.length(x["text"]) >= 20)), 0))
    t = t.withColumn("r", F.get(F.filter("t", lambda x: (x["role"] == "assistant") & (x["turn"] > F.col("m.turn"))), 0)).where("r IS NOT NULL")
    return t.select("conv_id", F.size(F.filter("t", lambda x: x["turn"] < F.col("m.turn"))).cast("long").alias("history"), F.md5("m.text").alias("message"), F.md5("r.text").alias("reference"))


@query(f"""WITH e AS (SELECT conv_id, turn, {ENC} AS ids, role = 'assistant' AS target FROM conversations), p AS (SELECT conv_id, turn, list_concat(ids[1:64], list_transform(range(greatest(0, 64 - len(ids))), lambda x: 0)) AS padded, list_concat(list_transform(ids[2:], lambda x: CASE WHEN target THEN x ELSE -100 END), [-100]) AS labels FROM e)
SELECT conv_id, turn, array_to_string(padded, ' ') AS padded, array_to_string(labels, ' ') AS labels FROM p""")
def corpus_padded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).withColumn("ids", tx.encoded(F.col("text")))
    target = F.array_repeat(F.col("role") == "assistant", F.size("ids"))
    text = lambda x, n: F.array_join(x.cast("array<string>"), " ").alias(n)
    return c.select("conv_id", "turn", text(tx.padded(F.col("ids"), 64), "padded"), text(tx.next_labels(F.col("ids"), target), "labels"))


@query("WITH t AS (SELECT source, sum(length(text))::bigint AS tokens FROM documents GROUP BY 1), r AS (SELECT *, CASE WHEN tokens < 100000 THEN 3 ELSE 1 END AS repeats FROM t) SELECT source, repeats::int AS repeats, tokens, tokens * repeats AS effective, round(tokens * repeats / sum(tokens * repeats) OVER (), 6) AS share FROM r")
def corpus_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir, "source", "text").select("source", F.length("text").alias("tokens"))
    return ops.mixture(sizes, F.when(F.col("tokens") < 100000, 3).otherwise(1))


@query("WITH r AS (SELECT doc_id, source, unnest(range(1, CASE WHEN source IN ('src1', 'src2') THEN 4 ELSE 2 END)) AS pass FROM documents) SELECT source, pass::int AS pass, count(*) AS n FROM r GROUP BY ALL")
def corpus_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "source")
    return ops.repeated(d, F.when(F.col("source").isin("src1", "src2"), 3).otherwise(1)).groupBy("source", "pass").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE row_number() OVER (PARTITION BY source ORDER BY md5('deal|' || doc_id::varchar), doc_id) WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END AS role FROM documents")
def corpus_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dealt(documents(spark, sf_dir, "doc_id", "source"), "source", "doc_id", "deal").select("doc_id", "role")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('hold|' || doc_id::varchar), doc_id) = 1")
def corpus_withheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("source").orderBy(cleaning.md5_order(F.col("doc_id"), "hold"), "doc_id"))
    return documents(spark, sf_dir, "doc_id", "source").withColumn("n", n).where("n = 1").drop("n")


LETTERS = f"t AS (SELECT {ROLE} AS role, unnest(string_split(text, '')) AS token FROM documents), tr AS (SELECT token, count(*) AS n FROM t WHERE role = 'train' GROUP BY 1), ev AS (SELECT token, count(*) AS m FROM t WHERE role <> 'train' GROUP BY 1)"


@query(f"WITH {LETTERS}, l AS (SELECT -sum(m * ln((coalesce(n, 0) + 1) / ((SELECT sum(n) FROM tr) + 300))) / sum(m) AS loss FROM ev LEFT JOIN tr USING (token)) SELECT round(loss, 6) AS loss, round(exp(least(loss, 20)), 4) AS perplexity FROM l")
def corpus_unigram_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "doc_id", "text")
    held = F.col("doc_id") % 20 < 2
    return ops.unigram_loss(ops.letters(d.where(~held), F.col("text")), ops.letters(d.where(held), F.col("text")), 300)


@query(f"WITH {LETTERS} SELECT token, n FROM tr")
def corpus_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.letters(documents(spark, sf_dir, "doc_id", "text").where("doc_id % 20 >= 2"), F.col("text"))


@query("WITH g AS (SELECT doc_id, unnest(list_transform(range(1, length(text) - 10), lambda i: substr(text, i, 12))) AS g FROM documents WHERE length(text) >= 12), c AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY ALL) SELECT doc_id, sum(c)::bigint AS grams, max(c) AS most, round(count(*) / sum(c), 6) AS distinct_ratio, max(c) >= 3 AS looping FROM c GROUP BY doc_id")
def corpus_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.repetition(documents(spark, sf_dir, "doc_id", "text"), "doc_id", F.col("text"))


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), f AS (SELECT source, CASE WHEN n = max(n) OVER () THEN 0.4::double ELSE least(3, floor(max(n) OVER () / n))::double END AS factor FROM s), e AS (SELECT doc_id, d.source, factor, unnest(range(3)) AS epoch FROM documents d JOIN f USING (source)),
t AS (SELECT *, CASE WHEN factor >= 1 THEN floor(factor)::bigint ELSE (('0x' || substr(md5('epoch|' || epoch::varchar || '|' || doc_id::varchar), 1, 8))::bigint % 1000 < factor * 1000)::bigint END AS times FROM e) SELECT epoch::int AS epoch, doc_id, unnest(range(1, times + 1)) AS pass FROM t WHERE times > 0""")
def corpus_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs: small sources repeated up to three times, of the largest one two rows in five, drawn anew."""
    d = documents(spark, sf_dir, "doc_id", "source")
    n = d.groupBy("source").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("most"))  # one row
    factor = n.crossJoin(F.broadcast(most)).select("source", F.when(F.col("n") == F.col("most"), 0.4).otherwise(F.least(F.lit(3), F.floor(F.col("most") / F.col("n"))).cast("double")).alias("factor"))
    return ops.epochs(d.join(factor, "source"), "doc_id", F.col("factor"), 3, "epoch").select("epoch", "doc_id", "pass")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::int AS place, role, text FROM conversations")
def corpus_nested_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations folded to nested messages, written as JSON records, read back with their schema and unfolded."""
    from ..sources.tables import as_record, records_of

    c = parquet(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    nested = ops.folded(c, "conv_id", ["turn"], ["role", "text"])
    read = records_of(nested.select(as_record("conv_id", "messages").alias("record")), "record", "conv_id long, messages array<struct<role: string, text: string>>")
    return ops.unfolded(read.where("corrupt IS NULL"), "conv_id")
