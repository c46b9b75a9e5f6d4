"""Streaming state over append-only progress logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.files import scratch


def latest_per_key(spark: SparkSession, path: str, schema: str, key: str, order: list[str]) -> DataFrame:
    """The last record of each key of a folder of JSON lines, read as a stream until nothing new is there. State is one record a key; files that were
    read are remembered in the checkpoint, so a restart goes on where it stopped."""
    out, mark = scratch(spark, "stream"), scratch(spark, "mark")
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(path).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c != key]
    state = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"), F.count("*").alias("seen"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)

    stream = state.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(keep).trigger(availableNow=True).start()
    stream.awaitTermination()
    got = spark.read.parquet(out).groupBy(key).agg(F.max_by(F.struct("_x", "seen"), "_batch").alias("_y"))
    return got.select(key, *[F.col(f"_y._x.{c}").alias(c) for c in rest], F.col("_y.seen").alias("seen"))


def windowed_counts(spark: SparkSession, path: str, schema: str, at: str, kind: str, width: str, late: str) -> DataFrame:
    """(window start, kind, n): event-time counts with a watermark, an extension over batch logs."""
    out, mark = scratch(spark, "windows"), scratch(spark, "mark")
    rows = spark.readStream.schema(schema).json(path).withWatermark(at, late)
    counts = rows.groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out)

    counts.writeStream.outputMode("update").option("checkpointLocation", mark).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("start", kind).agg(F.max_by("n", "_batch").alias("n"))
