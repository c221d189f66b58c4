"""Scans and sinks: explicit schemas, required columns, pruned columns, roles as partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A named table of a folder; the columns are pruned at the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def csv_strings(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """A CSV with header, every cell as literal text: nothing is read as null but an empty unquoted cell."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def csv_typed(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A CSV with header and an explicit schema; columns that aren't asked for are pruned at the scan."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return df.select(*columns) if columns else df


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def records(spark: SparkSession, path: str, separator: str, fields: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Text records between separators: (the parsed ones, counts of read and skipped). fields: name to regex with one group."""
    raw = spark.read.text(path, lineSep=separator).where(F.trim("value") != "")
    parsed = raw.select(*[F.regexp_extract("value", p, 1).alias(n) for n, p in fields.items()])
    ok = F.forall(F.array(*fields), lambda x: x != "")
    return parsed.where(ok), parsed.agg(F.count("*").alias("read"), F.count_if(~ok).alias("skipped"))


def stacked(*parts: DataFrame) -> DataFrame:
    """All rows of several parts, column names stripped of spaces."""
    clean = [p.toDF(*[c.strip() for c in p.columns]) for p in parts]
    out = clean[0]
    for p in clean[1:]:
        out = out.unionByName(p)
    return out


def head_groups(df: DataFrame, group: str, n: int) -> DataFrame:
    """The rows of the first n groups, by the group's key."""
    return df.join(df.select(group).distinct().orderBy(group).limit(n), group, "left_semi")


def stringified(df: DataFrame) -> DataFrame:
    """Every column that isn't a number, time or flag as string, for sinks that need one type a column."""
    keep = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)
    return df.select(*[F.col(f.name) if isinstance(f.dataType, keep) else F.col(f.name).cast("string").alias(f.name) for f in df.schema])


def write_roles(df: DataFrame, path: str, role: str = "split") -> None:
    """Parquet in a folder for each role, so that a read of one role never opens the others."""
    df.write.mode("overwrite").partitionBy(role).parquet(path)


def read_role(spark: SparkSession, path: str, name: str, order: str, role: str = "split") -> DataFrame:
    return spark.read.parquet(path).where(F.col(role) == name).orderBy(order)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, nested columns as nested objects."""
    df.write.mode("overwrite").json(path)


def as_record(*columns: Column) -> Column:
    """Columns as one JSON text."""
    return F.to_json(F.struct(*columns))


def records_of(texts: DataFrame, column: str, schema: str, corrupt: str = "corrupt") -> DataFrame:
    """The JSON texts of a column as columns of the schema, with the text itself in the corrupt column where it isn't such a record; other columns stay."""
    full = f"{schema}, {corrupt} string"
    parsed = texts.withColumn("record_", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}))
    return parsed.select(*[c for c in texts.columns if c != column], "record_.*")


def ordered(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error if its columns aren't exactly these in this order."""
    if df.columns != columns:
        raise ValueError(f"columns are {', '.join(df.columns)}; wanted {', '.join(columns)}")
    return df


def star(spark: SparkSession, folder: str, fact: str, dimensions: dict[str, tuple[str, str]], schemas: dict[str, str], sep: str = ",") -> DataFrame:
    """A fact table of CSV files with its dimensions joined on: name -> (fact's key, dimension's key). A fact without its dimension keeps nulls."""
    out = csv_typed(spark, f"{folder}/{fact}.csv", schemas[fact], sep=sep)
    for name, (key, own) in dimensions.items():
        other = csv_typed(spark, f"{folder}/{name}.csv", schemas[name], sep=sep)
        out = out.join(other.withColumnRenamed(own, "key_"), out[key] == F.col("key_"), "left").drop("key_")
    return out
