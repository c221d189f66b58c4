"""URL filter: host and path rules first, then logistic regression on hashed character n-grams.

The model is fitted by Spark ML on a small labelled URL table (label 1: block). Host and path
n-grams of three to five characters, each marked with its part, are hashed into counts. Scoring is
one pass over the urls, without a shuffle; only DataFrame functions and Spark ML run.

Null urls, and urls without "://", have an empty host and path, fit no rule, and get the model's
verdict on no n-grams. Repeated rows stay. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

# The rules of the contract, as (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
# Words of sites to block, by kind, and of sites to allow; words that stand with both; endings and places of urls.
BAD = {
    "gambling": "casino poker slots roulette jackpot betting bets bingo lottery blackjack".split(),
    "adult": "porn sex xxx nude escort cams erotic fetish adult milf".split(),
    "drugs": "viagra cialis pills pharma steroid xanax tramadol".split(),
    "fraud": "phishing malware keygen warez torrent crack hacked trojan ransom".split(),
    "advertising": "adserver popunder clickbait tracker backlinks spam seo banner affiliate doubleclick".split(),
    "money": "payday loan forex bitcoin giveaway prize winner jackpots cashback".split(),
}
GOOD = """academy archive artist bakery biology bridge camera castle chemistry church cinema city climate coffee college community county court
culture cycling daily design dictionary doctor energy engineer family farm festival fiction forest forum garden geology gallery gazette health
heritage history hospital hotel house journal kitchen language law library magazine market math medicine mountain museum music nature news novel
ocean orchestra park physics planet poetry police press project radio recipe research river safety school science society software sport station
store street student summer teacher theatre times tourism town train travel union university valley village weather wiki winter world writer zoo""".split()
SHARED = "best free online my top the new live hot cheap web club hub world zone".split()
ENDINGS = ("com", "net", "org", "info", "co.uk", "de", "fr", "io")
PLACES = ("https://{}.{}/", "http://www.{}.{}/index.html", "https://{}.{}/a/{}", "http://{}.{}/p?id={}", "https://shop.{}.{}/items/{}.html", "{}.{}")

WIDTH, SIZES = 1 << 16, (3, 4, 5)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct<rule,verdict> of the longest rule that fits, equal lengths by code point; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in reversed(ordered):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(part: str, text: Column) -> Column:
    padded = F.concat(F.lit("^"), text, F.lit("$"))
    each = [gram(part, text, padded, n) for n in SIZES]
    return F.concat(*each)


def gram(part: str, text: Column, padded: Column, n: int) -> Column:
    some = F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.concat(F.lit(part), F.substring(padded, i, F.lit(n))))
    return F.when((F.length(text) > 0) & (F.length(padded) >= n), some).otherwise(F.array().cast("array<string>"))


def invented(n: int) -> list[str]:
    """Names without a meaning, of two to four syllables: most sites have such a name, and the kind can't be read off it."""
    syllables = [c + v + e for c in ("b", "d", "f", "g", "k", "l", "m", "n", "r", "s", "t", "v") for v in "aeiou" for e in ("", "n", "r", "l", "s")]
    return ["".join(syllables[(i * 7919 + k * (k + i) * 104729) % len(syllables)] for k in range(2 + i % 3)) for i in range(n)]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label, name, stem): a small table. Each word alone, before and after another one; the allowed ones with words from both sides too."""
    rows = []
    bad = [(w, 1.0) for words in BAD.values() for w in words]
    for i, (word, label) in enumerate(bad + [(w, 0.0) for w in GOOD]):
        other = [SHARED[i % len(SHARED)], SHARED[(3 * i + 1) % len(SHARED)], (bad[(5 * i + 2) % len(bad)][0] if label else GOOD[(5 * i + 2) % len(GOOD)])]
        names = [word, f"{other[0]}-{word}", f"{word}-{other[1]}", f"{other[1]}{word}", f"{word}{other[2]}", f"{word}{i % 90 + 10}", f"{word}-{other[2]}"]
        rows += [(name, label, word) for name in names]
    rows += [(name, 0.0, name) for name in invented(400)]
    urls = [(PLACES[i % len(PLACES)].format(name, ENDINGS[(i // 3) % len(ENDINGS)], 17 * i), label, name, stem) for i, (name, label, stem) in enumerate(rows)]
    return spark.createDataFrame([(u if "://" in u else f"https://{u}/", *rest) for u, *rest in urls], "url string, label double, name string, stem string")


def held_out_auc(labelled: DataFrame, by: str = "name") -> float:
    """Area under the ROC curve on a fifth of the table, by a hash of its names or stems, of a model fitted on the rest."""
    aside = F.pmod(F.crc32(F.col(by)), F.lit(5)) == 0
    out = judge(labelled.where(aside), fit(labelled.where(~aside)), rules=())
    return BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(out.select("label", "score"))


def prepared(urls: DataFrame, url_col: str, host_col: str, path_col: str, gram_col: str) -> DataFrame:
    out = urls.withColumns({host_col: host_of(F.col(url_col)), path_col: path_of(F.col(url_col))})
    return out.withColumn(gram_col, F.concat(grams("h", F.col(host_col)), grams("p", F.col(path_col))))


def fit(labelled: DataFrame) -> PipelineModel:
    """From (url, label). The learning table is small by contract and is fitted in one partition, so that reruns agree."""
    rows = prepared(labelled.coalesce(1), "url", "host", "path", "grams")
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=WIDTH)
    model = LogisticRegression(regParam=0.01, maxIter=60, labelCol="label").fit(hashing.transform(rows).select("features", "label"))
    return PipelineModel([hashing, model])


def judge(pages: DataFrame, model: PipelineModel, url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and the model's score; names that pages has get underscores in front."""
    host, path, rule, verdict, score, g = fresh(pages, "host", "path", "rule", "verdict", "score", "url_grams")
    (f,) = fresh(pages, "url_features")
    rows = prepared(pages, url_col, host, path, g)
    hashing, logistic = (s.copy() for s in model.stages)
    hashing.setInputCol(g).setOutputCol(f)
    logistic.setFeaturesCol(f).setPredictionCol(f"{f}_p").setProbabilityCol(f"{f}_q").setRawPredictionCol(f"{f}_r")
    out = logistic.transform(hashing.transform(rows)).withColumn(score, F.get(vector_to_array(F.col(f"{f}_q")), 1))
    r = rule_of(F.col(host), F.col(path), rules)
    out = out.withColumn(rule, r["rule"]).withColumn(verdict, F.coalesce(r["verdict"], F.when(F.col(score) >= threshold, "block").otherwise("allow")))
    return out.select(*pages.columns, host, path, rule, verdict, score)


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "score")
