"""Cutting a plan from what it was made of."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def reliable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the cluster names. Where there is none a local master gets a temporary folder;
    on a cluster, whose executors couldn't see one, it is an error.

    Rows are the same however often they are read afterwards, also if executors are lost.
    """
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()
