"""Materialising intermediate frames where every executor can read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame


def materialised(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the session's ``spark.checkpoint.dir``; only a local session that sets
    none gets a folder of its own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/lodestone-checkpoints")
    return df.checkpoint(eager=True)
