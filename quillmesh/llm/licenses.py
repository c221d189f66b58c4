"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Lines of the whole text that speak of a license are compared with license templates; equal lines
are compared once. Token weights are (1 + ln tf) * idf; idf counts every such line of all
documents, and the templates. The best template of a line, from THRESHOLD on, is its license
(equal cosines: the first name), the best line's that of the document (then the first line).

The whole text and the header (first comment, or first paragraphs that speak of terms) of each
document with a word of TERMS are compared with full licence texts in the same way, from WHOLE on.

A document that is a full text as a whole, that has a license and is named like a licence file, or
of which such lines hold FILE_SHARE of the tokens is a licence file: its license counts
for its directory (of several files, the one with the first path). A document without a license
of its own inherits from the nearest directory above it that has one; directories are resolved
once each, by joins of paths with the paths of their ancestors.

Null texts and null paths count as empty; a path without "/" lies in the directory "". Repeated
rows stay. No documents: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, table, text_key, whole, written

# Short forms of the licenses as they stand in headers and licence files.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the 3-clause BSD License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the CC0 1.0 Universal license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
# Full texts stand beside this module. That of the Affero license is made from the GPL's, whose terms it shares.
TEXTS = Path(__file__).with_name("license_texts")
AFFERO = ("GNU General Public License", "GNU Affero General Public License")
CUE = r"licen[cs]e|public domain|spdx|all rights reserved"
TOKEN = r"[a-z0-9]+"
THRESHOLD, FILE_SHARE, WHOLE = 0.6, 0.5, 0.8
# Words of which every full text holds one; other documents are like none of them.
TERMS = r"licen[cs]e|public domain|copyright|redistribut|permission|warrant|liab(?:le|ility)"
NAMED = r"(?i)(?:^|/)(?:un)?(?:licen[cs]es?|copying|copyright)(?:[._-][^/]*)?$"
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|%|<!--|$)"


def template_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "tid int, license string, line string")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def full_texts() -> list[tuple[str, str]]:
    found = [(p.stem, re.sub(r"\s+", " ", p.read_text())) for p in sorted(TEXTS.glob("*.txt"))]
    return [*found, ("AGPL-3.0", re.sub(AFFERO[0], AFFERO[1], dict(found)["GPL-3.0"], flags=re.I))]


def header(text: Column) -> Column:
    """The first comment of a text; where it begins with none, its first paragraphs as long as they speak of terms."""
    boxed = F.regexp_extract(text, r"(?s)^\s*(?:#![^\n]*\n\s*)?(?:/\*.*?\*/|<!--.*?-->|\"{3}.*?\"{3}|'{3}.*?'{3})", 0)

    def until(xs: Column, stop: Callable[[Column, Column], Column]) -> Column:
        at = F.array_position(F.transform(xs, stop), True)
        return F.when(at > 0, F.slice(xs, F.lit(1), (at - 1).cast("int"))).otherwise(xs)

    said = F.array_join(let(F.split(text, "\n"), lambda a: until(a, lambda x, i: ~x.rlike(COMMENT))), "\n")
    plain = F.array_join(let(F.split(F.ltrim(text), r"\n\s*\n"), lambda a: until(a, lambda x, i: (i > 0) & ~x.rlike(TERMS))), "\n")
    return F.when(boxed != "", boxed).when(said.rlike(r"\S"), said).otherwise(plain)


def best_match(found: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """(key, license, score) of the texts in found (key, line, times) with a cosine from least on to a text in known (tid, license, line)."""
    every = found.select("line", "times").unionByName(known.select(F.lower("line").alias("line"), F.lit(1).cast("long").alias("times")))
    terms = every.select("times", F.explode(F.array_distinct(tokens(F.col("line")))).alias("t"))
    total = every.agg(F.sum("times").alias("total"))
    idf = terms.groupBy("t").agg(F.sum("times").alias("df")).crossJoin(F.broadcast(total)).select("t", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))

    def weights(df: DataFrame, key: str) -> DataFrame:
        tf = df.select(key, F.explode(tokens(F.lower("line"))).alias("t")).groupBy(key, "t").agg(F.count("*").alias("tf"))
        return tf.join(idf, "t").select(key, "t", ((F.log("tf") + 1) * F.col("idf")).alias("w"))

    mine, theirs = weights(found, "key"), weights(known, "tid")
    length = lambda df, key, name: df.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias(name))
    dots = mine.withColumnRenamed("w", "a").join(theirs.withColumnRenamed("w", "b"), "t").groupBy("key", "tid").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    cos = dots.join(length(mine, "key", "x"), "key").join(length(theirs, "tid", "y"), "tid").join(known.select("tid", "license"), "tid")
    cos = cos.select("key", "license", F.round(F.col("dot") / (F.col("x") * F.col("y")), 6).alias("score")).where(F.col("score") >= least)
    return cos.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "license"))).where("n = 1").select("key", "license", "score")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(docs: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, path, own, score, is_file, license, origin): the own license, whether the document is a licence file,
    the license that holds for it, and where that comes from: own, the directory it is inherited from, or null."""
    spark = docs.sparkSession
    text = whole(F.col(text_col))
    spoken = F.when(F.lower(text).rlike(CUE), F.filter(F.split(F.lower(text), "\n"), lambda x: x.rlike(CUE))).otherwise(F.array().cast("array<string>"))
    size = F.when(F.lower(text).rlike(CUE), F.size(tokens(text))).otherwise(0)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), spoken.alias("lines"), size.alias("size"))
    rows = written(rows, "lines")
    lines = written(rows.select(F.explode("lines").alias("line")).groupBy("line").agg(F.count("*").alias("times")), "distinct")

    best = best_match(lines.select(F.col("line").alias("key"), "line", "times"), template_rows(spark), THRESHOLD).withColumnRenamed("key", "line")
    best = written(best, "best")

    held = rows.where(F.size("lines") > 0).select("id", "path", "size", F.posexplode("lines").alias("at", "line")).join(best, "line")
    own = held.groupBy("id", "path").agg(
        F.min(F.struct((-F.col("score")).alias("n"), "at", "license", "score")).alias("b"), F.sum(F.size(tokens(F.col("line")))).alias("said"), F.max("size").alias("size"))
    own = own.select("id", "path", F.struct("b.n", F.lit(0).alias("order"), "b.license", "b.score").alias("b"), (F.col("said") >= FILE_SHARE * F.col("size")).alias("is_file"))

    # the whole text and its header against the full texts: a whole text that is one makes a licence file
    full = spark.createDataFrame([(i, name, line) for i, (name, line) in enumerate(full_texts())], "tid int, license string, line string")
    low = F.lower(text)
    parts = F.array(F.struct(F.lit(1).alias("order"), low.alias("line")), F.struct(F.lit(2).alias("order"), header(low).alias("line")))
    spots = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.explode(F.when(low.rlike(TERMS), parts)).alias("x"))
    spots = written(spots.select("id", "path", "x.order", "x.line", text_key(F.col("x.line")).alias("key")), "blocks")
    texts = written(spots.groupBy("key").agg(F.first("line").alias("line"), F.count("*").alias("times")), "texts")
    like = written(best_match(texts, full, WHOLE), "like")
    wide = spots.select("id", "path", "order", "key").join(like, "key")
    wide = wide.select("id", "path", F.struct((-F.col("score")).alias("n"), "order", "license", "score").alias("b"), (F.col("order") == 1).alias("is_file"))
    own = own.unionByName(wide).groupBy("id", "path").agg(F.min("b").alias("b"), F.max("is_file").alias("is_file"))
    own = own.select("id", "path", F.col("b.license").alias("own"), F.col("b.score").alias("score"), (F.col("is_file") | F.col("path").rlike(NAMED)).alias("is_file"))
    own = written(own, "own")
    files = own.where("is_file").select(directory(F.col("path")).alias("above"), F.struct("path", "own").alias("f")).groupBy("above").agg(F.min("f").alias("f"))
    files = files.select("above", F.col("f.own").alias("given"))

    place = rows.select(directory(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = place.select("dir", F.explode(F.array_distinct(chain)).alias("above")).join(files, "above")
    nearest = ancestors.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("g")).select("dir", F.col("g.above").alias("above"), F.col("g.given").alias("given"))
    nearest = written(nearest, "nearest")

    mark = F.xxhash64("id", "path")
    out = rows.select("id", "path").withColumn("dir", directory(F.col("path"))).withColumn("mark", mark)
    own = own.withColumn("mark", mark).select("mark", F.col("id").alias("own_id"), F.col("path").alias("own_path"), "own", "score", "is_file")
    out = out.join(own, (out["mark"] == own["mark"]) & out["id"].eqNullSafe(own["own_id"]) & (out["path"] == own["own_path"]), "left").join(nearest, "dir", "left")
    return out.select("id", "path", "own", "score", F.coalesce("is_file", F.lit(False)).alias("is_file"), F.coalesce("own", "given").alias("license"), F.when(F.col("own").isNotNull(), F.lit("own")).otherwise(F.col("above")).alias("origin"))


def document_path() -> Column:
    """Documents have no path; source, language and id stand for one. A null part is left out."""
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", document_path().alias("path"))
    return scan(docs).withColumnRenamed("id", "doc_id")


SQL = """
WITH templates AS (SELECT * FROM (VALUES TEMPLATE_ROWS) v(tid, license, line)
), d AS (
  SELECT doc_id, concat_ws('/', source, lang, doc_id::varchar) AS path, lower(coalesce(text, '')) AS text FROM documents
), l AS (
  SELECT doc_id, path, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d
), s AS (SELECT * FROM l WHERE regexp_matches(line, 'CUE_RE')
), lines AS (SELECT line, count(*) AS times FROM s GROUP BY line
), e AS (SELECT line, times FROM lines UNION ALL SELECT lower(line), 1 FROM templates
), idf AS (
  SELECT t, ln(((SELECT sum(times) FROM e)::double + 1) / (sum(times)::double + 1)) + 1 AS idf FROM (SELECT times, unnest(list_distinct(regexp_extract_all(line, '[a-z0-9]+'))) AS t FROM e) GROUP BY t
), m AS (
  SELECT line, t, (ln(count(*)) + 1) * any_value(idf) AS w FROM (SELECT line, unnest(regexp_extract_all(line, '[a-z0-9]+')) AS t FROM lines) JOIN idf USING (t) GROUP BY line, t
), k AS (
  SELECT tid, t, (ln(count(*)) + 1) * any_value(idf) AS w FROM (SELECT tid, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS t FROM templates) JOIN idf USING (t) GROUP BY tid, t
), mn AS (SELECT line, sqrt(sum(w * w)) AS x FROM m GROUP BY line
), kn AS (SELECT tid, sqrt(sum(w * w)) AS y FROM k GROUP BY tid
), c AS (
  SELECT m.line, tid, round(sum(m.w * k.w) / (any_value(x) * any_value(y)), 6) AS score FROM m JOIN k USING (t) JOIN mn USING (line) JOIN kn USING (tid) GROUP BY m.line, tid
), best AS (
  SELECT c.line, license, score FROM c JOIN templates USING (tid) WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY c.line ORDER BY score DESC, license) = 1
), own AS (
  SELECT doc_id, path, arg_min(license, (-score, place)) AS own, max(score) AS score, sum(len(regexp_extract_all(line, '[a-z0-9]+'))) >= 0.5 * max(len(regexp_extract_all(text, '[a-z0-9]+'))) AS is_file
  FROM s JOIN best USING (line) GROUP BY doc_id, path
), files AS (
  SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS above, arg_min(own, path) AS given FROM own WHERE is_file GROUP BY 1
), p AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM d
), near AS (
  SELECT dir, arg_max(above, length(above)) AS above, arg_max(given, length(above)) AS given FROM (SELECT DISTINCT dir FROM p) q JOIN files ON above = '' OR dir = above OR starts_with(dir, above || '/') GROUP BY dir
)
SELECT p.doc_id, p.path, own.own, own.score, coalesce(own.is_file, false) AS is_file, coalesce(own.own, near.given) AS license,
  CASE WHEN own.own IS NOT NULL THEN 'own' ELSE near.above END AS origin
FROM p LEFT JOIN own USING (doc_id) LEFT JOIN near USING (dir)
""".replace("TEMPLATE_ROWS", ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(TEMPLATES))).replace("CUE_RE", CUE)
