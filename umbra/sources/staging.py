"""Tables written between the rounds of iterative jobs, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A path of its own below spark.checkpoint.dir; where that is unset, a local session takes a temporary folder and a cluster refuses."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="umbra-checkpoint-"))
    return f"{sc.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage, so that lost executors cost no recomputation beyond this table, fixes what depends on
    the order of rows, and gives the planner the real size.
    """
    path = shared_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
