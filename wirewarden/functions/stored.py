"""Cutting a lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from files in the folder that the cluster names in spark.checkpoint.dir, so that what follows neither repeats what came before nor carries its plan.
    Only a local session may go without the setting and gets a temporary folder."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
