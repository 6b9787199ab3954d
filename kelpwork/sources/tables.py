"""Reading the engine's Parquet tables, and the folder in which lineage may be cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; only in local mode, where that is unset, a temporary folder of this
    machine is made. A cluster without the setting is an error: a folder of one machine is lost with it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and context.getCheckpointDir() is None and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not named:
        named = "file://" + os.path.join(tempfile.gettempdir(), "kelpwork-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hashed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows of ``df``, at most twice as many, chosen by a hash of ``key``: the same for any partitioning.

    Only ``key`` is read to count the rows, and the choice is a filter, so nothing is sorted and no task gathers more than
    its share.
    """
    space = 1 << 40
    share = min(1.0, rows / max(df.select(key).count(), 1))
    return df.where(F.pmod(F.xxhash64(key), F.lit(space)) < int(share * space) + 1).limit(2 * rows)
