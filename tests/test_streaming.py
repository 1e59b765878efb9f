"""Streams give what the same query gives over the whole table."""

import pytest
from pyspark.sql import functions as F

from chronolake.sources import readers
from chronolake.streaming import jobs, processors

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(4).write.parquet(str(tmp_path / "events"))
    return tmp_path


def stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(str(folder / "events")).schema).option("maxFilesPerTrigger", 2).parquet(str(folder / "events"))


def rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("how", ["tumbling", "sliding"])
def test_windows(spark, folder, how):
    args = ("event_type", "ts", "value", "1 day", *(["6 hours"] if how == "sliding" else []))
    # Every row is within the delay, so nothing is late whatever order files come in.
    jobs.run_once(jobs.windowed(stream(spark, folder), *args, late="90 days"), str(folder / "c"), how, "complete")
    assert rows(spark.table(how)) == rows(jobs.windowed(spark.read.parquet(str(folder / "events")), *args))


def test_detector(spark, folder):
    some = stream(spark, folder).where("user_id < 20")
    jobs.run_once(processors.over_stream_with_pandas_state(some, "user_id", "ts", "value", processors.RunningZ), str(folder / "c"), "z")
    out = spark.table("z")
    whole = spark.read.parquet(str(folder / "events")).where("user_id < 20")
    assert out.count() == whole.count()
    # Files come in any order, but what a state holds in the end is the same.
    want = {r.user_id: r.m for r in whole.groupBy("user_id").agg(F.avg("value").alias("m")).collect()}
    seen = {}
    for r in out.collect():
        seen.setdefault(r.user_id, []).append(r["mean"])
    assert all(any(abs(m - want[k]) < 1e-6 for m in v) for k, v in seen.items())


def test_online_view(spark, folder):
    q = jobs.to_online_view(stream(spark, folder).select("user_id", "ts", "value"), str(folder / "c"), str(folder / "view"), "user_id", "ts")
    q.awaitTermination()
    newest = max(p.name for p in (folder / "view").iterdir())
    whole = spark.read.parquet(str(folder / "events")).groupBy("user_id").agg(F.max("ts").alias("ts"))
    assert sorted(map(tuple, spark.read.parquet(str(folder / "view" / newest)).select("user_id", "ts").collect())) == sorted(map(tuple, whole.collect()))


def test_feature_table(spark, tmp_path):
    path = str(tmp_path / "features")
    day = "cast('2024-01-0{}' as timestamp)"
    first = spark.sql(f"select 1 as k, {day.format(1)} as ts, 1.0 as v union all select 2, {day.format(2)}, 2.0")
    more = spark.sql(f"select 1 as k, {day.format(1)} as ts, 9.0 as v union all select 1, {day.format(3)}, 3.0")
    readers.append_features(first, path, "k", "ts")
    readers.append_features(more, path, "k", "ts")
    got = readers.read_features(spark, path, "ts", "2024-01-01", "2024-01-02")
    assert sorted((r.k, float(r.v)) for r in got.collect()) == [(1, 9.0), (2, 2.0)]
    assert sorted((r.k, float(r.v)) for r in readers.online_view(spark.read.parquet(path).drop("day"), "k", "ts").collect()) == [(1, 3.0), (2, 2.0)]
    with pytest.raises(ValueError):
        readers.ingest(spark, "pigeon", "a", "b", "ts")
