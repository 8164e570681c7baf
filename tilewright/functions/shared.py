"""Cutting the lineage of loops through the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the folder in spark.checkpoint.dir and read again; a folder of our own only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    out = df.checkpoint(eager=True)
    gc.collect()
    sc._jvm.System.gc()  # the driver gives back what the plan took, and Spark's cleaner drops the shuffle files of lineages that were cut before
    return out
