"""Streaming forms: daily counts by watermark, and task state kept by a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(day, event_type, n, total) of a stream (ts, event_type, value); rows later than the watermark are dropped."""
    day = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return day.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


def current_state(log: DataFrame) -> DataFrame:
    """The state of each task after each batch of a change log (task_id, seq, status, flag): the same fold as the batch form."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, status, flag, began, n = state.get if state.exists else (-1, "", False, -1, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for r in rows.itertuples():
            if r.seq <= seq:
                continue
            began = -1 if r.status != "completed" else began if status == "completed" and began >= 0 else r.seq
            seq, status, flag, n = int(r.seq), r.status, bool(r.flag), n + 1
        state.update((seq, status, flag, int(began), n))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "flag": [flag], "completed_seq": [began if began >= 0 else None], "changes": [n]})

    out = "task_id long, status string, flag boolean, completed_seq long, changes long"
    return log.groupBy("task_id").applyInPandasWithState(fold, out, "seq long, status string, flag boolean, began long, n long", "update", "NoTimeout")
