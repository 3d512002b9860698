"""Pinning rows: written once to the folder that a cluster shares, so that later reads see the same ones."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def set_checkpoint_folder(spark: SparkSession) -> str:
    """Takes spark.checkpoint.dir; only a local session without it gets a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = _own_folder.setdefault("at", "file://" + tempfile.mkdtemp(prefix="sagewell-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table, in the folder that executors share."""
    return f"{set_checkpoint_folder(spark)}/sagewell-{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame) -> DataFrame:
    """df as checkpointed now: computed once, and the same rows in the same partitions ever after."""
    set_checkpoint_folder(df.sparkSession)
    return df.checkpoint()
