"""Personal data: candidate gradient boosting over high-recall generators.

Two layers, both in one pass over each text and without a shuffle:

* base spans: strict patterns for email, ip, card and phone with their validity checks;
* added spans: broad generators propose overlapping candidates, boosted trees score them on
  format and context, and a threshold per kind, calibrated on candidates that the trees
  haven't seen, selects those to report besides the base.

The trees are fitted by Spark ML on the candidates of all documents; equal rows of features are
counted and weigh as many. The base patterns can't label what they don't know, so
the base spans are written anew, in place, in forms that the base misses (obfuscated
addresses, other separators, a digit mistyped so that the check fails): these are personal
data, as the spans themselves are. Other candidates, and look-alikes put in the same
places (dates, versions, amounts, book numbers), are not. Candidates that have a base pattern's
form and fail only its check are in neither class: the trees decide on them. The checks themselves
(Luhn sum, parts up to 255) are no features. The fitted trees are written out as a column
expression.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, span_text, spans, table, whole

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive quantifiers and look-behinds keep the matches of
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ and the others, in linear time and without recursion.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The generators, wider than the base.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}(?:[.,][0-9]{1,3}){3,}+|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![0-9A-Fa-f])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,}+",
    "phone": r"(?:\+|(?<![0-9])00|\(|(?<![0-9.+]))(?<![0-9])[0-9(][0-9().\x20/-]{6,24}[0-9](?![0-9])",
}
#: What every match of a kind holds, base or wide: most texts have none of it and are done with one quick search.
GATES = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9][.,][0-9]|:[0-9A-Fa-f]{1,4}:", "card": r"[0-9](?:[\x20./-]?[0-9]){11}", "phone": r"[0-9][0-9().\x20/-]{6,}"}
#: What every text that passes a gate holds.
FIRST_GATE = r"[0-9@]|[\[(]at[\])]|:[A-Fa-f]{1,4}:"
# Words that stand before such data.
CUES = {
    "email": r"(?i)(mail|contact|write|adresse|correo)",
    "ip": r"(?i)(\bip\b|host|server|addr|ping|node)",
    "card": r"(?i)(card|visa|credit|amex|master|karte|carte|tarjeta|pan\b)",
    "phone": r"(?i)(phone|tel\b|tel[.:]|call|mobil|fax|whatsapp)",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Look-alikes, digits to be filled in for #.
LOOKALIKES = ("20##-0#-1# 1#:2#", "v#.##.#-#.#", "#,###,###,###", "978-#-##-######-#", "#.##############", "19##-20##", "###/####/##")
#: Different rows of features that one task of the training holds.
PART_ROWS = 50000
CONTEXT = 24
PRECISION = 0.95
SEED = 17


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""

    def term(d: Column, i: Column) -> Column:
        v = d.cast("int")
        return F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2)

    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), term)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "email":
        return F.lit(True)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def base_spans(text: Column) -> Column:
    """array<struct<k,kind,s,e>> of the base, by kind as listed and start."""
    found = []
    for k, kind in enumerate(KINDS):
        found.append(base_of(k, kind, spans(text, BASE[kind], 0, GATES[kind])))
    return F.concat(*found)


def base_of(k: int, kind: str, matches: Column) -> Column:
    ok = F.filter(matches, lambda x: valid(kind, x["m"]))
    return F.transform(ok, lambda x: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


FEATURES = ["kind", "length", "digits", "letters", "dots", "dashes", "spaces", "parens", "colons", "ats", "plus", "groups", "longest", "shortest", "upper", "tail_letters", "before_word", "after_word", "after_mark", "cue", "other_cue"]


def features(kind: str, k: int, x: Column) -> list[Column]:
    """Format and context of a candidate x; no validity check is among them."""
    m = x["m"]
    n = lambda cls: F.length(F.regexp_replace(m, cls, ""))
    runs = F.filter(F.split(m, "[^0-9]+"), lambda r: r != "")
    lens = F.transform(runs, lambda r: F.length(r))
    other = "|".join(f"(?:{CUES[o][4:]})" for o in KINDS if o != kind)
    values = [
        F.lit(k), F.length(m), n("[^0-9]"), n("[^A-Za-z]"), n("[^.]"), n("[^-]"), n("[^ ]"), n("[^()]"), n("[^:]"), n("[^@]"), n("[^+]"), F.size(runs),
        F.coalesce(F.array_max(lens), F.lit(0)), F.coalesce(F.array_min(lens), F.lit(0)), n("[^A-Z]"), F.length(F.regexp_extract(m, "[A-Za-z]*$", 0)),
        x["l"].rlike(r"\w$").cast("int"), x["r"].rlike(r"^\w").cast("int"), x["r"].rlike(r"^[.,:/%][0-9]").cast("int"), x["l"].rlike(CUES[kind]).cast("int"), x["l"].rlike(f"(?i){other}").cast("int"),
    ]
    return [v.cast("double").alias(f) for f, v in zip(FEATURES, values, strict=True)]


def candidates(text: Column) -> Column:
    """array<struct<k,kind,s,e,x: struct of features>> of all generators; spans of different kinds may overlap."""
    found = []
    for k, kind in enumerate(KINDS):
        found.append(candidates_of(k, kind, spans(text, WIDE[kind], CONTEXT, GATES[kind])))
    return F.concat(*found)


def candidates_of(k: int, kind: str, matches: Column) -> Column:
    return F.transform(matches, lambda x: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.struct(*features(kind, k, x)).alias("x")))


def meets(x: Column, others: Column, same_kind: bool) -> Column:
    """Whether span x overlaps one of the others."""
    return F.exists(others, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]) & ((x["k"] == y["k"]) if same_kind else F.lit(True)))


class Model:
    """Boosted trees as text, and a threshold for each kind (over 1: none is added)."""

    def __init__(self, trees: list[tuple[float, list[str]]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, x: Column) -> Column:
        """0 to 1 for a struct of features, to six digits, in which thresholds are given as well."""
        margin = F.lit(0.0)
        for weight, lines in self.trees:
            margin = margin + F.lit(weight) * tree_column(lines, x)
        return F.round(1 / (1 + F.exp(-2 * margin)), 6)


def tree_column(lines: list[str], x: Column) -> Column:
    """One tree, in the lines of Spark's toDebugString, as nested conditions on the struct x."""
    at = 0

    def node() -> Column:
        nonlocal at
        line = lines[at].strip()
        at += 1
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        i, bound = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # the line of Else
        return F.when(x[FEATURES[int(i)]] <= float(bound), low).otherwise(node())

    return node()


def digits_in(pattern: Column, key: Column) -> Column:
    """pattern with digits of a hash of key for each #."""
    number = F.regexp_replace(F.concat(F.md5(key), F.md5(F.concat(key, F.lit("+")))), "[a-f]", "7")
    marks = F.split(pattern, "(?<=.)(?=.)")
    return F.array_join(F.transform(marks, lambda c, i: F.when(c == "#", F.substring(number, i + 1, F.lit(1))).otherwise(c)), "")


def rewritten(kind: Column, m: Column) -> Column:
    """array<string>: a base span in forms that the base doesn't know, each still personal data."""
    bare = F.regexp_replace(m, "[^0-9]", "")
    last = F.concat(F.left(bare, F.length(bare) - 1), ((F.right(bare, F.lit(1)).cast("int") + 3) % 10).cast("string"))
    fours = lambda digits, sep: F.regexp_replace(digits, "([0-9]{4})(?=.)", f"$1{sep}")
    at = lambda x, y: F.regexp_replace(F.regexp_replace(m, "@", x), "\\.(?=[A-Za-z0-9-]+(\\.|$| \\[| \\(|\\[|\\())", y)
    forms = {
        "email": [at(" [at] ", " [dot] "), at("(at)", "(dot)"), at("[at]", ".")],
        "ip": [F.regexp_replace(m, "\\.", ","), F.regexp_replace(F.substring(F.md5(m), 1, 32), "(.{4})(?=.)", "$1:")],
        "card": [last, fours(bare, "."), fours(bare, "/"), fours(last, " ")],
        "phone": [F.regexp_replace(m, "^\\+", "00"), F.regexp_replace(m, "^\\+[0-9]+[ .-]?(?=[(0-9])", ""), F.regexp_replace(m, "[ -]", "/")],
    }
    out = F.array().cast("array<string>")
    for k, v in forms.items():
        out = F.when(kind == k, F.array(*v)).otherwise(out)
    return out


def formed(k: int, kind: str, matches: Column) -> Column:
    """The matches of a base pattern, what stands around them, and whether they pass the check."""
    return F.transform(matches, lambda x: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), *[x[c].alias(c) for c in "semlr"], valid(kind, x["m"]).alias("ok")))


def examples(docs: DataFrame) -> DataFrame:
    """(held, what, x, label): the candidates of (held, text) that are in one of the classes, in one pass over the texts."""
    text, none = F.col("text"), F.lit(None)
    matches = F.concat(*[formed(i, k, spans(text, BASE[k], CONTEXT, GATES[k])) for i, k in enumerate(KINDS)])
    rows = docs.where(text.rlike(FIRST_GATE)).select("held", matches.alias("formed"), candidates(text).alias("found"))
    rows = rows.select("held", "found", F.filter("formed", lambda x: x["ok"]).alias("base"), F.filter("formed", lambda x: ~x["ok"]).alias("failing"))
    # candidates as they are, with features x, and base spans to be rewritten, with their match m
    named = lambda *values: F.struct(*[v.alias(n) for n, v in zip(("what", "x", "label", "m", "l", "r"), values, strict=True)])
    text_none = none.cast("string")
    real = F.transform(F.filter("found", lambda c: ~meets(c, F.col("failing"), True)), lambda c: named(c["kind"], c["x"], meets(c, F.col("base"), True).cast("double"), text_none, text_none, text_none))
    spots = F.transform("base", lambda b: named(b["kind"], none.cast(f"struct<{', '.join(f'{f}: double' for f in FEATURES)}>"), none.cast("double"), b["m"], b["l"], b["r"]))
    rows = rows.select("held", F.explode(F.concat(real, spots)).alias("e")).select("held", "e.*")

    other = F.transform(F.array(*[F.lit(x) for x in LOOKALIKES]), lambda p: digits_in(p, F.concat(p, F.col("m"))))
    tag = lambda forms, label: F.transform(forms, lambda f: F.struct(f.alias("form"), label.alias("label")))
    forms = F.concat(tag(rewritten(F.col("what"), F.col("m")), F.lit(1.0)), tag(other, F.lit(0.0)))
    rows = rows.select("held", "what", "x", "l", "r", F.explode(F.when(F.col("m").isNull(), tag(F.array(text_none), F.col("label"))).otherwise(forms)).alias("p"))
    rows = rows.select("held", "what", "x", "p.label", F.char_length("l").alias("at"), (F.char_length("l") + F.char_length("p.form")).alias("to"), F.concat("l", "p.form", "r").alias("snippet"))
    there = lambda c: (c["s"] < F.col("to")) & (c["e"] > F.col("at")) & ((F.col("label") == 0) | (c["kind"] == F.col("what")))
    planted = F.transform(F.filter(candidates(F.col("snippet")), there), lambda c: F.struct(c["kind"].alias("what"), c["x"].alias("x")))
    rows = rows.select("held", "label", F.explode(F.when(F.col("snippet").isNull(), F.array(F.struct("what", "x"))).otherwise(planted)).alias("e"))
    return rows.select("held", "e.what", "e.x", "label")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the trees on the candidates of all documents and calibrate the thresholds on the quarter of the texts that they haven't seen.

    Equal texts are on one side; id_col stays for callers and is not read. No candidates, or candidates of one class only: a model that adds nothing.
    """
    d = docs.select(whole(F.col(text_col)).alias("text"))
    d = d.select("text", (F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(4)) == 0).alias("held"))
    each = ["held", "what", "label", *FEATURES]
    rows = examples(d).select("held", "what", "label", "x.*").groupBy(*each).agg(F.count("*").cast("double").alias("n")).persist()
    try:
        train = rows.where(~F.col("held"))
        size = train.agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).first()
        if size["low"] == size["high"]:
            return Model([], dict.fromkeys(KINDS, 2.0))
        train = dealt(train, size["n"], each).sortWithinPartitions(*each)  # sums in the same order in each run
        # Spark ML takes the bounds of the bins from maxBins squared rows at most; these are all
        bins = max(32, math.isqrt(size["n"]) + 1)
        gbt = GBTClassifier(weightCol="n", maxIter=10, maxDepth=3, maxBins=bins, stepSize=0.4, seed=SEED, maxMemoryInMB=64)
        fitted = gbt.fit(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train).select("features", "label", "n"))
        model = Model(read_trees(fitted.toDebugString), {})
        model.thresholds = calibrate(rows.where("held").select("what", "label", "n", model.score(F.struct(*FEATURES)).alias("score")))
        return model
    finally:
        rows.unpersist()


def dealt(train: DataFrame, rows: int, by: list[str]) -> DataFrame:
    """train in parts of about PART_ROWS rows. Each of the trees' many jobs has a task for each part, so what fits in one isn't dealt out anew."""
    parts = 1 + rows // PART_ROWS
    return train.coalesce(1) if parts == 1 else train.repartition(parts, *by)


def read_trees(text: str) -> list[tuple[float, list[str]]]:
    trees: list[tuple[float, list[str]]] = []
    for line in text.split("\n")[1:]:
        if m := re.match(r"\s*Tree \d+ \(weight (\S+)\):", line):
            trees.append((float(m[1]), []))
        elif line.strip():
            trees[-1][1].append(line)
    return trees


def calibrate(scored: DataFrame) -> dict[str, float]:
    """For each kind the smallest score from which on at least PRECISION of the held-out candidates, n to a row, are personal data."""
    each = scored.groupBy("what", "score").agg(F.sum(F.col("label") * F.col("n")).alias("hit"), F.sum("n").alias("n"))
    above = "OVER (PARTITION BY what ORDER BY score DESC)"
    cut = each.selectExpr("what", "score", f"sum(hit) {above} / sum(n) {above} AS precision").where(F.col("precision") >= PRECISION)
    found = {r["what"]: r["low"] for r in cut.groupBy("what").agg(F.min("score").alias("low")).collect()}  # a row for each kind
    return {k: max(0.5, found.get(k, 2.0)) for k in KINDS}


def detect(docs: DataFrame, model: Model, text_col: str = "text", base_col: str = "base", all_col: str = "spans") -> DataFrame:
    """docs with two columns of array<struct<k,kind,s,e>>: the base, and all spans, both by kind and start.

    Where docs has a column of such a name, the new one gets underscores in front. Null texts count as empty and have no span. Rows, repeated ones too, stay as they are.
    """
    base_col, all_col, t, c = fresh(docs, base_col, all_col, "pii_text", "pii_found")
    text = F.col(t)
    out = docs.withColumn(t, F.when(F.col(text_col).cast("string").rlike(FIRST_GATE), whole(F.col(text_col))).otherwise("")).withColumn(base_col, base_spans(text))
    if model.trees:
        limit = lambda x: F.element_at(F.create_map(*[y for k in KINDS for y in (F.lit(k), F.lit(float(model.thresholds[k])))]), x["kind"])
        scored = F.transform(candidates(text), lambda x: F.struct(x["k"].alias("k"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), model.score(x["x"]).alias("p")))
        out = out.withColumn(c, F.filter(scored, lambda x: (x["p"] >= limit(x)) & ~meets(x, F.col(base_col), False)))
    else:
        out = out.withColumn(c, F.array().cast("array<struct<k:int,kind:string,s:int,e:int,p:double>>"))
    # the best of overlapping candidates; ties by kind and start
    ranked = F.array_sort(F.transform(F.col(c), lambda x: F.struct((-x["p"]).alias("p"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    plain = lambda x: F.struct(x["k"].alias("k"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))
    chosen = F.aggregate(ranked, F.array().cast("array<struct<k:int,kind:string,s:int,e:int>>"), lambda a, x: F.when(meets(x, a, False), a).otherwise(F.concat(a, F.array(plain(x)))))
    everything = F.array_sort(F.transform(F.concat(F.col(base_col), chosen), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    return out.withColumn(all_col, F.transform(everything, plain)).drop(t, c)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; overlapping spans become one, named after the first.

    A null text stays null. All columns keep their names and order.
    """
    b, a = fresh(docs, "pii_base", "pii_spans")
    text = F.col(text_col)
    order = F.array_sort(F.transform(F.col(a), lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["kind"].alias("kind"), x["e"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        clear = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(clear).alias("out"))

    new = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    found = detect(docs, model, text_col, b, a)
    return found.withColumn(text_col, F.when(F.size(a) > 0, new).otherwise(text)).select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect(docs, fit(docs)).drop("text")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
