"""Conversation prefix trie: a Z-fast trie, built in batches, and its edges expanded to nodes.

A conversation is a sequence of turns; a prefix of it is known by a fingerprint of 128 bits, the xor
of the hashes of its (place, turn) pairs. The trie over all distinct conversations is compacted: a
node is kept where paths part or a conversation ends, with its depth and the conversation (rep) whose
path leads there. Between a node and its parent lies an edge of any length.

* Each edge is hashed at its handle: the path up to the two-fattest depth of the edge, the number in
  (parent's depth, depth] that the most powers of two divide.
* A conversation finds the node where it leaves the trie by fat binary search: it looks up its prefix
  at the two-fattest depth of the range that is left, and goes below the edge that has this handle,
  or above that depth. So there are as many look-ups as bits in the longest conversation's length.
* A batch is located in the trie as it stands. From there it goes in rounds: each conversation splits
  the edge that it leaves, where it leaves it; of those that leave at the same place with the same
  turn the longest becomes a new leaf, and the others go on along its edge. There are at most as many
  rounds as nodes on a path.
* Sums over subtrees come from the nodes on each conversation's path; then every edge is expanded to
  a row for each depth, along its rep's path.

No window, array or group holds a whole conversation: turns are put in order by ranges, fingerprints
are chained in chunks of CHUNK turns, paths are rows (conversation, depth). Equal conversations
are one path with a count. The hash of the members that end at a node is taken by a stream over
texts of at most RUN ids, in order; its memory doesn't grow with their number, its time does.

Turns are ordered by turn, null first, then role and the MD5 of the text; repeated rows are turns of
their own. A null role or text counts as empty; rows with a null conversation id take no part.
No conversations: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import place
from .common import dropped, table, written

CHUNK, RUN = 4096, 8192
#: The first batch is one in FIRST of the distinct conversations, the second one the rest.
FIRST = 8
#: Depths that are matched with edges at once.
SPAN = 1024
P = ["a", "b"]  # a fingerprint
NOBODY = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, d, k, chars): the turns of each conversation in order, d from 1; k stands for role and text."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = rows.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("t"), full(role).alias("role"), F.md5(full(text)).alias("m"), F.char_length(full(text)).cast("long").alias("chars")).where("c IS NOT NULL")
    r = r.withColumn("k", F.md5(F.concat(F.md5("role"), "m")))
    order = F.struct("c", "t", "role", "m", F.rand(11))  # the last part lets many equal rows of one conversation be dealt out
    at = written(place(r, ["c", "k", "chars"], order, hold=lambda df: written(df, "ordered")), "places")
    start = at.groupBy("c").agg(F.min("place").alias("start"))
    return at.join(start, "c").select("c", (F.col("place") - F.col("start") + 1).alias("d"), "k", "chars")


def rebuilt(own: DataFrame, head: Column, group: int) -> tuple[DataFrame, DataFrame]:
    """(c, n) of every conversation, and its turns (c, d, k, chars): the first head turns (a condition on c) of conversation c - c % group, then its own from there on."""
    size = own.groupBy("c").agg(F.max("d").alias("own"))
    base = size.where(F.col("c") % group == 0).select(F.col("c").alias("base"), F.col("own").alias("theirs"))
    plan = size.withColumns({"head": head.cast("long"), "base": F.col("c") - F.col("c") % group}).join(base, "base", "left")
    plan = plan.withColumn("taken", F.least("head", F.coalesce("theirs", F.lit(0).cast("long"))))
    plan = plan.select("c", "base", "head", "taken", (F.col("taken") + F.greatest(F.lit(0).cast("long"), F.col("own") - F.col("head"))).alias("n"))
    tops = own.where(F.col("c") % group == 0).select(F.col("c").alias("base"), "d", "k", "chars")
    most = plan.agg(F.max("head")).first()[0] or 0
    first = plan.join(tops.where(F.col("d") <= most), "base").where("d <= taken").select("c", "d", "k", "chars")
    rest = own.join(plan, "c").where("d > head").select("c", (F.col("d") - F.col("head") + F.col("taken")).alias("d"), "k", "chars")
    return plan.select("c", "n"), first.unionByName(rest)


def prefixes(rows: DataFrame) -> DataFrame:
    """(c, d, a, b, len, chars): the fingerprint and the code points of the first d turns, and those of the last one."""
    g = rows.select("c", "d", "chars", F.xxhash64(F.lit(1), "d", "k").alias("ga"), F.xxhash64(F.lit(2), "d", "k").alias("gb"), F.floor((F.col("d") - 1) / CHUNK).alias("chunk"))
    up_to = Window.partitionBy("c", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    inside = g.select("c", "d", "chunk", "chars", F.bit_xor("ga").over(up_to).alias("a"), F.bit_xor("gb").over(up_to).alias("b"), F.sum("chars").over(up_to).alias("len"))
    total = g.groupBy("c", "chunk").agg(F.bit_xor("ga").alias("ta"), F.bit_xor("gb").alias("tb"), F.sum("chars").alias("tl"))
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row for CHUNK turns
    zero = F.lit(0).cast("long")
    start = total.select("c", "chunk", F.coalesce(F.bit_xor("ta").over(before), zero).alias("sa"), F.coalesce(F.bit_xor("tb").over(before), zero).alias("sb"), F.coalesce(F.sum("tl").over(before), zero).alias("sl"))
    return inside.join(start, ["c", "chunk"]).select("c", "d", F.col("a").bitwiseXOR(F.col("sa")).alias("a"), F.col("b").bitwiseXOR(F.col("sb")).alias("b"), (F.col("len") + F.col("sl")).alias("len"), "chars")


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] that the most powers of two divide."""
    return F.expr(f"{high} & shiftleft(-1L, length(bin({low} ^ {high})) - 1)")


def marks(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of the paths that are nodes, each with the node before it on the path (pd 0: the root)."""
    on = paths.join(nodes.select(*P).hint("merge"), P)
    before = Window.partitionBy("x").orderBy("d")
    zero = F.lit(0).cast("long")
    return on.withColumns({f"p{c}": F.coalesce(F.lag(c).over(before), zero) for c in ("a", "b", "d", "len")})


def edges(paths: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The handles and the first turns of the edges: (a, b, depth, rep), by the fingerprint of the path up to there."""
    at = marks(paths, nodes).join(nodes.select(*P, "rep"), P).where("x = rep").select("rep", F.col("d").alias("depth"), F.col("pd").alias("low"))
    at = at.withColumns({"f": fattest("low", "depth"), "first": F.col("low") + 1})
    on = lambda where: at.join(paths.select(F.col("x").alias("rep"), F.col("d").alias(where), *P), ["rep", where]).select(*P, "depth", "rep")
    return on("f"), on("first")


def located(batch: DataFrame, paths: DataFrame, handles: DataFrame, firsts: DataFrame, bits: int) -> DataFrame:
    """(x, n, y, known): for each conversation of the batch a rep whose path it leaves last."""
    own = lambda at: paths.select("x", F.col("d").alias(at), *P)
    h = handles.select(*P, F.col("depth").alias("hit"), F.col("rep").alias("by"))
    zero = F.lit(0).cast("long")
    s = batch.select("x", "n", zero.alias("low"), F.col("n").alias("high"), F.lit(None).cast("long").alias("y"), zero.alias("depth"))
    for _ in range(bits):
        s = s.withColumn("f", F.when(F.col("low") < F.col("high"), fattest("low", "high")))
        s = s.join(own("f"), ["x", "f"], "left").join(h, P, "left")
        met, open_ = F.col("hit").isNotNull(), F.col("f").isNotNull()
        s = s.select("x", "n", F.when(open_ & met, F.least("hit", "high")).otherwise(F.col("low")).alias("low"), F.when(open_ & ~met, F.col("f") - 1).otherwise(F.col("high")).alias("high"), F.when(met, F.col("by")).otherwise(F.col("y")).alias("y"), F.when(met, F.col("hit")).otherwise(F.col("depth")).alias("depth"))
    s = s.withColumn("f", F.col("depth") + 1).join(own("f"), ["x", "f"], "left")
    s = s.join(firsts.select(*P, F.col("rep").alias("below")), P, "left")
    return s.select("x", "n", F.coalesce("below", "y").alias("y"), zero.alias("known"))


def inserted(state: DataFrame, paths: DataFrame) -> list[DataFrame]:
    """Nodes (a, b, depth, rep) that the located conversations (x, n, y, known) add; some may be there already."""
    out = []
    while True:
        mine = state.join(paths.select("x", "d", *P), "x").where("d >= known")
        theirs = paths.select(F.col("x").alias("y"), "d", F.col("a").alias("ya"), F.col("b").alias("yb"))
        same = F.coalesce((F.col("a") == F.col("ya")) & (F.col("b") == F.col("yb")), F.lit(False))
        far = lambda c: F.max_by(c, F.when(same, F.col("d")))
        then = lambda c: F.min_by(c, F.when(~same, F.col("d")))
        left = mine.join(theirs, ["y", "d"], "left").groupBy("x").agg(F.first("n").alias("n"), F.first("y").alias("y"), F.coalesce(F.max(F.when(same, F.col("d"))), F.lit(0).cast("long")).alias("exit"), far("a").alias("a"), far("b").alias("b"), then("a").alias("na"), then("b").alias("nb"))
        left = written(left, "exits")
        split = left.where("exit > 0").groupBy(*P).agg(F.min("exit").alias("depth"), F.min("y").alias("rep"))
        going = left.where("exit < n")
        lead = going.groupBy("na", "nb").agg(F.min(F.struct((-F.col("n")).alias("n"), "x")).alias("z")).select("na", "nb", F.col("z.x").alias("z"), (-F.col("z.n")).alias("zn"))
        leaf = lead.join(paths.select(F.col("x").alias("z"), F.col("d").alias("zn"), *P), ["z", "zn"]).select(*P, F.col("zn").alias("depth"), F.col("z").alias("rep"))
        out.append(split.unionByName(leaf))
        state = written(going.join(lead, ["na", "nb"]).where("x <> z").select("x", "n", F.col("z").alias("y"), (F.col("exit") + 1).alias("known")), "going")
        if state.isEmpty():
            return out


def merged(parts: list[DataFrame]) -> DataFrame:
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return written(every.groupBy(*P).agg(F.min("depth").alias("depth"), F.min("rep").alias("rep")), "nodes")


def build(paths: DataFrame, strings: DataFrame) -> DataFrame:
    """(a, b, depth, rep): the nodes of the compacted trie of the conversations (x, n) with turns, without its root."""
    one = strings.agg(F.max("n").alias("n"), F.count("*").alias("rows")).first()
    none = F.lit(None).cast("long")
    in_first = F.pmod(F.xxhash64(F.lit(17), "x"), F.lit(FIRST)) == 0
    start = strings.where(in_first).select("x", "n", none.alias("y"), F.lit(0).cast("long").alias("known"))
    nodes = merged(inserted(start, paths))
    handles, firsts = (written(e, "handles") for e in edges(paths, nodes))
    place_of = written(located(strings.where(~in_first), paths, handles, firsts, int(one["n"]).bit_length()), "located")
    return merged([nodes, *inserted(place_of, paths)])


def ends_hash(ends: DataFrame) -> DataFrame:
    """(a, b, sha): SHA-256 of the ids c of each fingerprint, ascending, comma-joined."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lo = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)), 0
            out = []
            while lo < len(rows):
                hi = lo
                while hi < len(rows) and hi - lo < RUN and rows[hi][:2] == rows[lo][:2]:
                    hi += 1
                out.append((*rows[lo], ",".join(str(r[2]) for r in rows[lo:hi])))
                lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["a", "b", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, out = None, None, []
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["a", "b", "sha"])
        for batch in batches:
            for a, b, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, h.hexdigest()))
                    key, h = (a, b), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield made(out)
            out = []
        if key is not None:
            yield made([(*key, h.hexdigest())])

    runs = ends.select(*P, "c").repartitionByRange(*P, "c").sortWithinPartitions(*P, "c").mapInArrow(texts, "a long, b long, first long, ids string")
    return runs.repartition(*P).sortWithinPartitions(*P, "first").mapInArrow(hashes, "a long, b long, sha string")


def expanded(paths: DataFrame, strings: DataFrame, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each node of the trie, its root included, with the figures of its subtree. strings: (x, n, m, a, b), m the number of equal conversations."""
    on = written(marks(paths, nodes).join(strings.select("x", "m"), "x"), "marks")
    node = on.groupBy(*P).agg(F.sum("m").alias("n_convs"), F.min("x").alias("rep"), *[F.min(c).alias(c) for c in ("d", "len", "pa", "pb", "pd", "plen")])
    kids = node.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("kids"))
    node = written(node.join(kids, P, "left").fillna(0, ["kids"]), "node")
    cost = F.when(F.col("rep") == F.col("x"), (F.col("n_convs") - 1) * (F.col("len") - F.col("plen"))).otherwise(0)
    below, path = Window.partitionBy("x").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("x")
    each = on.join(node.select(*P, "n_convs", "rep", "kids"), P).select(*P, "pd", cost.alias("cost"), F.coalesce(F.sum(cost).over(below), F.lit(0)).alias("below"), F.max((F.col("kids") == 0).cast("long")).over(path).alias("leaf"))
    each = written(each, "sums")
    sums = each.groupBy(*P).agg(F.sum("below").alias("below"), F.sum("leaf").alias("n_leaves"))
    sha = written(ends_hash(ends), "ends")

    rootless = each.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("saved_tokens"), F.coalesce(F.sum(F.when(F.col("pd") == 0, F.col("leaf"))), F.lit(0)).alias("leaves"))
    root = ends.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").crossJoin(rootless)  # one row each
    root = root.crossJoin(node.agg(F.count_if(F.col("pd") == 0).alias("n_children"))).join(sha.where("a = 0 AND b = 0").select("sha"), how="left")  # one row
    zero = F.lit(0).cast("long")
    root = root.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), "saved_tokens", F.coalesce("sha", F.lit(NOBODY)).alias("ends_sha256"))

    least = ends.agg(F.min("c").alias("root_conv"))  # one row
    up = node.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("rep").alias("up"))
    edge = node.join(sums, P).join(sha, P, "left").join(up, ["pa", "pb"], "left").crossJoin(F.broadcast(least))
    edge = edge.select("rep", "pd", F.col("d").alias("end"), F.col("len").alias("end_len"), "n_convs", "kids", "n_leaves", "below", "sha", F.when(F.col("pd") == 0, F.col("root_conv")).otherwise(F.col("up")).alias("up"))
    span = lambda c: F.floor(c / SPAN)
    edge = edge.withColumn("span", F.explode(F.sequence(span(F.col("pd") + 1), span(F.col("end")))))
    row = paths.select(F.col("x").alias("rep"), "d", "len", "chars").withColumn("span", span(F.col("d"))).join(edge, ["rep", "span"]).where("d > pd AND d <= end")
    last = F.col("d") == F.col("end")
    inner = row.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("pd") + 1, F.col("up")).otherwise(F.col("rep")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * (F.col("end_len") - F.col("len") + F.col("chars"))).alias("saved_tokens"), F.when(last, F.coalesce("sha", F.lit(NOBODY))).otherwise(NOBODY).alias("ends_sha256"),
    )
    return inner.unionByName(root)


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """The nodes of the trie of the conversations (c, n) with the turns (c, d, k, chars)."""
    path = written(prefixes(rows), "prefixes")
    zero = F.lit(0).cast("long")
    ends = convs.join(path.select("c", F.col("d").alias("n"), *P), ["c", "n"], "left").select("c", "n", *[F.coalesce(x, zero).alias(x) for x in P])
    ends = written(ends, "conversations")
    strings = written(ends.where("n > 0").groupBy(*P).agg(F.min("c").alias("x"), F.min("n").alias("n"), F.count("*").alias("m")), "strings")
    paths = written(path.join(strings.select(F.col("x").alias("c")), "c").withColumnRenamed("c", "x"), "paths")
    dropped(path)
    nodes = build(paths, strings) if not strings.isEmpty() else strings.select(*P, F.col("n").alias("depth"), F.col("x").alias("rep"))
    return expanded(paths, strings, nodes, ends)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    convs, rows = rebuilt(own, F.crc32(F.col("c").cast("string")) % 6, 100)
    return trie(convs, rows)


SQL = """WITH RECURSIVE poly AS (SELECT i::BIGINT AS i, i::BIGINT AS v, 0 AS k FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM poly WHERE k < 8),
  own AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS d FROM conversations WHERE conv_id IS NOT NULL),
  crc AS (SELECT DISTINCT c, c::VARCHAR AS s, 0 AS pos, 4294967295::BIGINT AS v FROM own UNION ALL SELECT crc.c, s, pos + 1, xor(crc.v // 256, poly.v) FROM crc JOIN poly ON poly.k = 8 AND poly.i = xor(crc.v % 256, ord(substr(s, pos + 1, 1))::BIGINT) WHERE pos < length(s)),
  plan AS (SELECT c, c - c % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE pos = length(s)),
  lens AS (SELECT c, max(d) AS n FROM own GROUP BY c),
  parts AS (SELECT p.c, 0 AS part, o.d, o.role, o.text FROM plan p JOIN own o ON o.c = p.base AND o.d <= p.h UNION ALL SELECT p.c, 1, o.d, o.role, o.text FROM plan p JOIN own o ON o.c = p.c AND o.d > p.h),
  whole AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, d) AS d, role, text FROM parts),
  paths AS (SELECT c, d, length(text) AS chars, list({'r': role, 't': text}) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM whole
    UNION ALL SELECT c, 0, 0, [] FROM plan),
  nodes AS (SELECT p, min(c) AS conv_id, any_value(d) AS depth, any_value(chars) AS chars, count(*) AS n_convs FROM paths GROUP BY p),
  ups AS (SELECT n.conv_id, n.depth, u.conv_id AS parent FROM nodes n JOIN paths x ON x.c = n.conv_id AND x.d = n.depth - 1 JOIN nodes u ON u.p = x.p),
  kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM ups GROUP BY ALL),
  full_ AS (SELECT n.*, ups.parent, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN ups USING (conv_id, depth) LEFT JOIN kids k ON k.parent = n.conv_id AND k.depth = n.depth),
  sums AS (SELECT u.p, sum((f.n_convs - 1) * f.chars)::BIGINT AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves FROM full_ f JOIN paths x ON x.c = f.conv_id AND x.d <= f.depth JOIN nodes u ON u.p = x.p GROUP BY u.p),
  ends AS (SELECT x.p, sha256(string_agg(x.c::VARCHAR, ',' ORDER BY x.c)) AS sha FROM paths x JOIN (SELECT c, max(d) AS d FROM paths GROUP BY c) l USING (c, d) GROUP BY x.p)
SELECT conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(sha, sha256('')) AS ends_sha256 FROM full_ JOIN sums USING (p) LEFT JOIN ends USING (p)"""
