"""Labelled rows for the classifiers: a bounded, deterministic sample of the learning folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_bucket


def labelled_ids(labels: DataFrame, column: str, bound: int, seed: int) -> DataFrame:
    """(id, label): at most bound ids of the learning folds, those with the smallest hashes.

    Null ids and null labels take no part; an id with several labels counts as the largest.
    """
    rows = labels.select(F.col("doc_id").alias("id"), F.col(column).cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (fold_bucket(F.col("id")) != 0))
    return rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(bound)


def arrays(rows: DataFrame, value: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The values and index sets of a bounded sample (id, value, at), in order of id; by Arrow, without a Python object for each index."""
    t = rows.toArrow().combine_chunks()
    values, at = t.column(value).to_numpy(), t.column("at").combine_chunks()
    ends, flat = at.offsets.to_numpy(), at.values.to_numpy(zero_copy_only=False)
    first = np.array([flat[a] if b > a else -1 for a, b in zip(ends, ends[1:], strict=False)])
    order = np.lexsort((first, np.diff(ends), values, t.column("id").to_numpy()))
    return values[order], [flat[ends[i] : ends[i + 1]].astype(np.int64) for i in order]
