"""Where iterative operators cut their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def use_shared_folder(spark: SparkSession) -> None:
    """Checkpoints go to the folder that spark.checkpoint.dir names.  Where it is
    unset, one is made, but only if driver and executors are one process."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexspan-"))
