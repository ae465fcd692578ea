"""Structured Streaming over the events table: a bounded run that drains what is there and reads the sink back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; watermarks need a timestamp with zone."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all that is available into Parquet of the shared folder and read it."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/tessella/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")
