"""Folders for work in progress, and cutting lineage in iterative plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_folder(spark: SparkSession) -> str:
    """The session's folder among the checkpoints, which the cluster shares. Where none is set, a folder of this machine serves a local
    session; on a cluster, whose machines do not share folders, that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + os.path.join(tempfile.gettempdir(), "lumenscan-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the work folder."""
    work_folder(df.sparkSession)
    return df.checkpoint()


def shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join that is shuffled whatever Spark takes their size for. It estimates by the columns of the table that rows are made from:
    texts and lists that a rule makes of a few bytes a row count as next to nothing, and a broadcast of them is put together by the driver."""
    return rows.hint("merge")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the work folder that nobody has used."""
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
