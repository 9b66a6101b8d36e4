"""Incremental summaries of late catalog rows: windows of event time, redshift bins, mergeable sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators.binning import assign_bin


def windowed_bins(stream: DataFrame, time: str, z: str, theta: str, edges: list[float], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``(start, bin, n, mean, std)`` per tumbling window and redshift bin. On a stream the watermark bounds the state; on a table it has no effect. Rows without time, outside the edges or without a size are left out."""
    rows = stream.filter(F.col(time).isNotNull()).select(F.col(time).cast("timestamp").alias("t"), assign_bin(F.col(z), edges).alias("bin"), F.col(theta).alias("v"))
    rows = rows.filter("bin is not null and v is not null and not isnan(v)").withWatermark("t", late)
    g = rows.groupBy(F.window("t", window).alias("w"), "bin").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))
    return g.select(F.col("w.start").alias("start"), "bin", "n", "mean", "std")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append what the watermark has closed, stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
