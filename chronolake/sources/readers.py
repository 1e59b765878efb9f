"""Sources and sinks: files, databases, streams, feature tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, missing_to_null, names
from chronolake.operators.joins import latest_known


def csv(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """With a stated schema: nothing is inferred, so files are read once."""
    return spark.read.schema(schema).options(header="true", **options).csv(path)


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, ts: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Columns and an inclusive time range go down to the scan."""
    df = spark.read.parquet(path)
    if start:
        df = df.where(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end:
        df = df.where(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df.select(*columns) if columns else df


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def kafka(spark: SparkSession, servers: str, topic: str, schema: str) -> DataFrame:
    """JSON values of a topic as columns. Needs the connector's jar on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def ingest(spark: SparkSession, kind: str, start: str, end: str, ts: str, **where: str) -> DataFrame:
    """A time range of a source by its kind; kinds that aren't there are an error."""
    if kind == "parquet":
        return parquet(spark, where["path"], ts=ts, start=start, end=end)
    if kind == "sql":
        return spark.sql(where["query"]).where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    if kind == "jdbc":
        return jdbc(spark, where["url"], where["query"]).where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    raise ValueError(f"no source of kind {kind}")


def parse_ts(column: str, unit: str = "text", fmt: str | None = None, zone: str | None = None) -> Column:
    """Text, epoch seconds or milliseconds as a timestamp, moved to a zone if one is given."""
    c = F.col(column)
    t = F.timestamp_seconds(c) if unit == "s" else F.timestamp_millis(c) if unit == "ms" else F.to_timestamp(c, fmt) if fmt else F.to_timestamp(c)
    return F.from_utc_timestamp(t, zone) if zone else t


def nulls_for_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: missing_to_null(F.col(c)) for c, k in df.dtypes if k in ("double", "float")})


def append_features(df: DataFrame, path: str, entity: Names, ts: str, day: str = "day") -> None:
    """Add feature rows to a table partitioned by day, one row for each entity and time; only days that occur are rewritten."""
    spark = df.sparkSession
    new = df.withColumn(day, F.to_date(ts))
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is not None:
        days = new.select(day).distinct()
        kept = old.join(days, day, "left_semi").join(new.select(*names(entity), ts), [*names(entity), ts], "left_anti")
        new = new.unionByName(kept)
    # Read rows must not be overwritten while they are read.
    new = new.dropDuplicates([*names(entity), ts])
    staged = f"{path.rstrip('/')}__staged"
    new.write.mode("overwrite").partitionBy(day).parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_features(spark: SparkSession, path: str, ts: str, start: str, end: str, day: str = "day") -> DataFrame:
    """Feature rows of a time range, both ends in; days outside are never opened."""
    return spark.read.parquet(path).where(F.col(day).between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).where(F.col(ts).between(F.lit(start), F.lit(end)))


def online_view(df: DataFrame, entity: Names, ts: str) -> DataFrame:
    """The newest known value of each feature per entity."""
    return latest_known(df, entity, ts)
