"""Cutting lineage in a way that survives the loss of executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``. Only where the session names
    none and runs on one machine, as in tests, a temporary folder is set, which goes
    with the process; on a cluster that would lose what a lost executor wrote, so it is an error.
    Files in a shared folder are removed by Spark with
    ``spark.cleaner.referenceTracking.cleanCheckpoints``."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not (sc.master or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="platewright-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage ending there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)
