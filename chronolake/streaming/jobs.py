"""Windows with event time: the same functions take streams and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chronolake.functions.windows import Names, expanding, names


def watermarked(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as a timestamp, with a watermark; on a whole table the watermark does nothing."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def windowed(df: DataFrame, by: Names, ts: str, value: str, size: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Tumbling windows, or sliding ones: start, rows and sum."""
    keys = names(by)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    d = watermarked(df, ts, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))
    return d.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "value")


def sessions(df: DataFrame, by: Names, ts: str, value: str, gap: str, late: str = "0 seconds") -> DataFrame:
    """Sessions that end after ``gap`` without a row."""
    keys = names(by)
    d = watermarked(df, ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("value"))
    return d.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "value")


def deduplicated(df: DataFrame, keys: Names, ts: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    d = watermarked(df, ts, late)
    return d.dropDuplicatesWithinWatermark(names(keys)) if df.isStreaming else d.dropDuplicates(names(keys))


def running_z(df: DataFrame, entity: Names, ts: Names, value: str) -> DataFrame:
    """Mean and z-score after each row, from all rows up to it; 0 before there is a deviation. The stateful form is ``processors.RunningZ``."""
    w = expanding(entity, ts)
    sd = F.stddev_samp(value).over(w)
    z = F.when((F.count(value).over(w) >= 2) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0)
    return df.withColumns({"mean": F.avg(value).over(w), "z": z})


def run_once(df: DataFrame, checkpoint: str, name: str, mode: str = "append") -> StreamingQuery:
    """All that is there now, into a table in memory, to its end."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def to_online_view(df: DataFrame, checkpoint: str, path: str, entity: Names, ts: str) -> StreamingQuery:
    """Keep the newest row of each entity in a table, batch by batch. Each batch writes a version; the newest complete one counts."""
    keys = names(entity)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if number:
            rows = rows.unionByName(spark.read.parquet(f"{path}/version={number - 1}"))
        rest = [c for c in batch.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("r")).select(*keys, "r.*")
        newest.write.mode("overwrite").parquet(f"{path}/version={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
