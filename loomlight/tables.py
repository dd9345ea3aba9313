"""Tables written between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where it is unset, a folder of this machine, for sessions of one machine only."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if context.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="loomlight-")


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder, with a plan of their own.

    Spark deletes them when nothing refers to them any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    session, context = df.sparkSession, df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(session))
    rows = df.checkpoint(eager=True)
    # a checkpoint keeps the size and the constraints that were estimated for its plan; over
    # rounds of joins these grow to numbers of thousands of digits, so the rows get a plan of their own
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows._jdf.queryExecution().toRdd(), rows._jdf.schema(), False), session)


#: Rows of a small table that may be broadcast: some MB if rows are a hundred bytes or two.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, to be broadcast if it has few rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
