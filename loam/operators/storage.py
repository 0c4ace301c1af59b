"""Cutting lineage in storage that executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` checkpointed under spark.checkpoint.dir; a local session without one gets its own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = sc.getConf().get("spark.checkpoint.dir")
        if path is None and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if path is None:
            own = tempfile.mkdtemp(prefix="loam-checkpoints-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            path = f"file://{own}"
        sc.setCheckpointDir(path)
    return df.checkpoint()
