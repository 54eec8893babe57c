"""Streaming extensions: a windowed count with a watermark, and an upsert of the last record per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.manifest import last_record


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum per event type and tumbling window; works on streams and tables alike."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def upsert_latest(events: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keeps in ``path`` the last record of each key; every batch makes a new version folder, named by its number.

    A batch that is run again writes the same version from the same predecessor.
    """
    import os.path

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        now = last_record(df, keys, [F.col(c) for c in order])
        if number > 0:
            now = last_record(spark.read.parquet(os.path.join(path, f"v{number - 1}")).unionByName(now), keys, [F.col(c) for c in order])
        now.write.mode("overwrite").parquet(os.path.join(path, f"v{number}"))

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
