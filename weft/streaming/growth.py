"""Growing graphs from a stream of edges: Structured Streaming into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.shared import fresh_path


def degree_stream(edges: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window, id, degree): darts per vertex and event-time window of edges(ts, src, dst).

    Rows later than ``late`` behind the newest are dropped by the watermark,
    so the state holds open windows only.
    """
    ends = edges.withWatermark("ts", late).select("ts", F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy(F.window("ts", window).alias("window"), "id").agg(F.count(F.lit(1)).alias("degree"))


def grow(edges: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery:
    """Appends each batch's edges below path as Parquet, numbered (batch, o) in the order of arrival.

    A batch that is written again after a failure replaces its own folder, so
    every edge is there once.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.lit(number).cast("long").alias("batch"), F.monotonically_increasing_id().alias("o"), F.col("src").cast("long"), F.col("dst").cast("long"))
        rows.write.mode("overwrite").parquet(f"{path}/n={number}")

    spark = edges.sparkSession
    return edges.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or fresh_path(spark, "stream")).trigger(availableNow=True).start()


def grown(spark, path: str) -> DataFrame:
    """(batch, o, src, dst) of all batches so far."""
    return spark.read.parquet(path).select("batch", "o", "src", "dst")
