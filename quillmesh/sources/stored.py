"""Tables written down between the rounds of a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: For local sessions without spark.checkpoint.dir.
LOCAL = "/tmp/checkpoints/quillmesh"


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder in spark.checkpoint.dir, without its lineage. A local session may leave the setting out; a cluster without it is an error."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not root and (master.startswith("local-cluster") or not master.startswith("local")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(root or LOCAL)
    return df.checkpoint()
