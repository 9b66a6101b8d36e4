"""The incremental summary as a stream equals the one over the table, for what the watermark has closed."""

from pyspark.sql import functions as F

from skyloom.streaming.binned import run_once, windowed_bins


def test_stream(spark, tmp_path):
    rows = spark.range(400).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("t"), (F.col("id") % 4 + 0.5).alias("z"), (F.col("id") * 0.01).alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    edges = [0.0, 2.0, 4.0]
    stream = windowed_bins(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "t", "z", "v", edges)
    run_once(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["start", "bin"]).reset_index(drop=True)
    want = windowed_bins(rows, "t", "z", "v", edges).toPandas().sort_values(["start", "bin"]).reset_index(drop=True)
    want = want[want.start.isin(got.start)].reset_index(drop=True)
    assert len(got) > 10 and got.equals(want[got.columns])
