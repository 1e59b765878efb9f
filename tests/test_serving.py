"""Served forecasts: the stream over several batches and a restart against the table, and features that expire."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolake.streaming import serving

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "user long, ts timestamp, id long, value double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, was)


def made(seed=5):
    """Five users over twelve days: one silent for days, one with missing values, ties of time."""
    rng, rows = np.random.default_rng(seed), []
    for user in range(5):
        at = 0.0
        for i in range(40):
            at += float(rng.exponential(6)) if user != 1 or i != 20 else 60.0
            value = None if user == 2 and i % 7 == 3 else float(rng.normal(10 + i / 5, 1))
            rows.append((user, DAY + dt.timedelta(seconds=int((at if user != 3 else round(at / 12) * 12) * 3600)), user * 100 + i, value))
    return rows


def plain(rows, keep, least, expiry):
    out, state = {}, {}
    for user, ts, i, value in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        held, n, last = state.get(user, ([], 0, None))
        if last is not None and ts - last > expiry:
            held, n, last = [], 0, None
        out[i] = (n, None)
        if value is not None:
            if len(held) >= least:
                b, a = np.polyfit(range(len(held)), held, 1)
                out[i] = (n, round(float(a + b * len(held)), 6))
            held, n, last = [*held, value][-keep:], n + 1, ts
        state[user] = (held, n, last)
    return out


def got(df):
    return {r.id: (r.known, None if r.forecast is None else round(r.forecast, 6)) for r in df.collect()}


def test_table(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    out = serving.serve_table(df, "user", ["ts", "id"], "value", keep=8, least=5, expiry_ms=86_400_000)
    want = plain(rows, 8, 5, dt.timedelta(days=1))
    assert got(out) == want
    assert any(k == 0 for i, (k, _) in want.items() if i % 100 > 5), "somebody starts anew"
    assert serving.serve_table(df.where(F.lit(False)), "user", "ts", "value").count() == 0


def test_stream_with_a_restart(spark, rocks, tmp_path):
    rows = made()
    kept = {"keep": 8, "least": 5, "expiry_ms": 86_400_000}
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for part in range(3):
        # Four days at a time: each run goes on from the state that the run before left.
        some = [r for r in rows if (r[1] - DAY).days // 4 == part or (part == 2 and (r[1] - DAY).days >= 12)]
        spark.createDataFrame(some, SCHEMA).repartition(1).write.mode("append").parquet(source)
        served = serving.serve_stream(spark.readStream.schema(SCHEMA).parquet(source), "user", ["ts", "id"], "value", late="1 hour", **kept)
        served.writeStream.option("checkpointLocation", check).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(rows)
    out = got(out)
    assert out == plain(rows, 8, 5, dt.timedelta(days=1))


def test_online_table_expires(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "table")
    hours = lambda k: DAY + dt.timedelta(hours=k)
    for some in ([(1, hours(0), 1, 1.0), (2, hours(1), 2, 2.0), (2, hours(0), 3, 9.0)], [(3, hours(30), 4, 3.0), (2, hours(20), 5, 5.0)]):
        spark.createDataFrame(some, SCHEMA).repartition(1).write.mode("append").parquet(source)
        serving.to_online_table(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "check"), path, "user", "ts", "24 HOURS").awaitTermination()
    rows = serving.online_table(spark, path)
    assert sorted((r.user, r.value) for r in rows.collect()) == [(2, 5.0), (3, 3.0)]
    asked = spark.createDataFrame([(1, hours(31)), (2, hours(31)), (2, hours(44)), (3, hours(29)), (3, hours(30)), (None, hours(31))], "user long, now timestamp")
    met = serving.lookup(asked, rows, "user", "ts", "now", "24 HOURS", "value").collect()
    assert sorted(((r.user or 0), r.now.day * 24 + r.now.hour - 24, r.value, r.found) for r in met) == [(0, 31, None, False), (1, 31, None, False), (2, 31, 5.0, True), (2, 44, None, False), (3, 29, None, False), (3, 30, 3.0, True)]
