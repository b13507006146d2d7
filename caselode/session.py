"""Session helpers shared by all plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


_CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of this machine only in local mode, where it is unset.

    Checkpoints nobody refers to any more are deleted, unless the session says otherwise.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if sc.getConf().get(_CLEAN, None) is None:
        sc._jsc.sc().conf().set(_CLEAN, "true")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="caselode-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the loss of executors, and later readers don't recompute."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
