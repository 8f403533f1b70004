"""Chunked clustering as a stream: each file of a folder is one micro-batch fed to the carried state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.operators.cluster import ChunkedClustering


def stream_points(spark: SparkSession, folder: str) -> DataFrame:
    """Point files of ``folder``, one file per micro-batch, oldest first."""
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).option("wholetext", False).text(folder)
    parts = lines.select(F.split("value", ",").alias("v"))
    return parts.select(F.col("v")[0].alias("id"), F.transform(F.slice("v", F.lit(2), F.size("v") - 1), lambda x: x.cast("double")).alias("features"))


def cluster_stream(spark: SparkSession, folder: str, checkpoint: str, *, k: int = 10, max_rounds: int = 1000) -> ChunkedClustering:
    """Runs over the files that are there, feeding each micro-batch, and finishes; batches without points are skipped."""
    state = ChunkedClustering(k=k, max_rounds=max_rounds)

    def feed(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            state.feed(batch)

    query = stream_points(spark, folder).writeStream.option("checkpointLocation", checkpoint).foreachBatch(feed).trigger(availableNow=True).start()
    query.awaitTermination()
    state.finish()
    return state
