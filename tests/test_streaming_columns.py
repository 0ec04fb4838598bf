"""Column functions are stateless, so they run unchanged on a streaming DataFrame."""

from pyspark.sql import functions as F

from pathloom.functions.arrays import left_pad, position_mask
from pathloom.functions.times import decompose_time, epoch_seconds_rounded


def test_columns_on_a_stream(spark, tmp_path):
    data = spark.createDataFrame([([1, 2],), ([3],)], "s array<int>").withColumn("ts", F.timestamp_seconds(F.lit(60)))
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    shaped = stream.select(
        left_pad(F.col("s"), 3).alias("p"), position_mask(F.size("s"), 2).alias("m"),
        epoch_seconds_rounded(F.col("ts")).alias("t"), decompose_time(F.array(F.lit(0))).alias("d"),
    )
    running = (shaped.writeStream.format("memory").queryName("shaped").trigger(availableNow=True)
               .option("checkpointLocation", str(tmp_path / "state")).start())
    running.awaitTermination(60)
    got = sorted(tuple(r) for r in spark.table("shaped").collect())
    assert got == [([0, 0, 3], [0, 0], 60, [[1970, 1, 1, 0, 0, 0]]), ([0, 1, 2], [0, 1], 60, [[1970, 1, 1, 0, 0, 0]])]
