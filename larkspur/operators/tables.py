"""Tables that are written in between, in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local session that names none uses its warehouse, any other raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that all executors share")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/.checkpoints")
    return context.getCheckpointDir()


def cut(rows: DataFrame) -> DataFrame:
    """``rows``, written to the shared folder, so that a lost executor does not undo what came before."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
