"""The folder that all machines share, for tables that later steps go on from."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Only where that is unset in a local session, as in tests, a temporary folder is set; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if spark.conf.get("spark.checkpoint.dir", None) is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so that a lost executor costs no earlier step and plans stay short."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that deals both sides by their keys.

    Sizes are estimated from the files that were read, as if exploded and repeated rows took no room, so that a join left to
    the planner would send whole tables by way of the driver.
    """
    return left.join(right.hint("merge"), on, how)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys (or in turn) into as many tasks as a shuffle has, before work that is long for its bytes: a file of one row group is one task's otherwise, and few bytes are put together in few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
