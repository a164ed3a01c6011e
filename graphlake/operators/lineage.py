"""Cutting the lineage of iterative plans with copies that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the shared folder of spark.checkpoint.dir.

    Where that is unset, a new local folder serves a local session; on a cluster the setting must be there.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        told = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not told and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="graphlake-"))
    return df.checkpoint()
