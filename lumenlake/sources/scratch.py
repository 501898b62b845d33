"""Folders for what a query has to write on its way: tables of deltas, checkpoints and results of streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which all executors share; in local mode a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="lumenlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lumenlake/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def run_now(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that is at hand, written to folder/rows; its state and offsets stay in folder/checkpoint, where a later run goes on."""
    rows = f"{folder}/rows"
    writer = stream.writeStream.format("parquet").option("path", rows).option("checkpointLocation", f"{folder}/checkpoint")
    query = writer.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
