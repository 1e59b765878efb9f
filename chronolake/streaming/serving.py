"""Forecasts served from state by entity, and a table of newest features that expire.

The state has a twin over whole tables, made of windows, with the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from chronolake.functions.windows import Names, names


def line_ahead(values: np.ndarray, horizon: int) -> tuple[float, float]:
    """What the least-squares line through equally spaced values says ``horizon`` places after the last, and its slope."""
    t = np.arange(len(values)) - (len(values) - 1) / 2
    slope = float(t @ (values - values.mean()) / (t @ t)) if len(values) > 1 else 0.0
    return float(values.mean() + slope * (t[-1] + horizon)), slope


def _schema(df: DataFrame, keys: list[str], ts: list[str], value: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, *ts]), f"`{value}` double, `known` long, `forecast` double, `slope` double"])


def server(keys: list[str], ts: list[str], value: str, keep: int, least: int, expiry_ms: int, horizon: int) -> StatefulProcessor:
    """State of an entity: its last ``keep`` values by place, how many there were, and the time of the last. A timer forgets it when event time passes its expiry."""

    class Served(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.recent = handle.getMapState("recent", "place long", "value double")
            self.seen = handle.getValueState("seen", "n long, last long")

        def forget(self) -> None:
            self.recent.clear()
            self.seen.clear()

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            n, last = self.seen.get() if self.seen.exists() else (0, None)
            first = last
            held = [v for _, v in sorted((k[0], v[0]) for k, v in self.recent.iterator())] if n else []
            start = n - len(held)
            pdf = pd.concat(list(rows)).sort_values(ts)
            made = []
            for at, x in zip(pd.to_datetime(pdf[ts[0]]).astype("datetime64[us]").astype("int64"), pdf[value].astype(float), strict=True):
                if last is not None and at - last > expiry_ms * 1000:
                    held, n, last, start = [], 0, None, 0
                    self.recent.clear()
                if last is not None and at < last or np.isnan(x):
                    made.append((n, None, None))
                    continue
                made.append((n, *(line_ahead(np.array(held), horizon) if len(held) >= least else (None, None))))
                held, n, last = [*held, x][-keep:], n + 1, at
            for p in range(start, n - len(held)):
                if self.recent.containsKey((p,)):
                    self.recent.removeKey((p,))
            for p, v in zip(range(n - len(held), n), held, strict=True):
                self.recent.updateValue((p,), (v,))
            if last is None:
                self.forget()
            elif last != first:
                self.seen.update((n, int(last)))
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old if isinstance(old, int) else old[0])
                self.handle.registerTimer(int(last) // 1000 + expiry_ms + 1)
            else:
                self.seen.update((n, int(last)))
            known, forecast, slope = zip(*made, strict=True)
            yield pd.DataFrame({**{k: [v] * len(pdf) for k, v in zip(keys, key, strict=True)}, **{c: pdf[c].to_numpy() for c in ts}, value: pdf[value].astype(float).to_numpy(), "known": known, "forecast": pd.array(forecast, "Float64"), "slope": pd.array(slope, "Float64")})

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            self.forget()
            return iter(())

        def close(self) -> None:
            """Nothing is held besides the state."""

    return Served()


def serve_stream(df: DataFrame, entity: Names, ts: Names, value: str, keep: int = 48, least: int = 5, expiry_ms: int = 86_400_000, horizon: int = 1, late: str = "0 seconds") -> DataFrame:
    """Each row of a stream with ``known``, the values held of its entity before it, and the forecast of these, ``horizon`` places on, with its ``slope``.

    The forecast is the line through the last ``keep`` values; it is null below ``least`` of them. More than ``expiry_ms`` without a row, and the
    entity starts anew. A row older than one already taken in, or without a value, gets no forecast and doesn't count. The first of ``ts`` is
    event time, others part ties. RocksDB has to be the provider of the state store.
    """
    keys, times = names(entity), names(ts)
    d = df.select(*keys, *times, value).withWatermark(times[0], late)
    return d.groupBy(*keys).transformWithStateInPandas(server(keys, times, value, keep, least, expiry_ms, horizon), _schema(df, keys, times, value), "Append", "eventTime")


def serve_table(df: DataFrame, entity: Names, ts: Names, value: str, keep: int = 48, least: int = 5, expiry_ms: int = 86_400_000, horizon: int = 1) -> DataFrame:
    """:func:`serve_stream` over a whole table, as if its rows had come in order of time.

    An entity's order is one window; places and sums of the last ``keep`` values are frames of it.
    """
    keys, times = names(entity), names(ts)
    at = F.unix_micros(F.col(times[0]).cast("timestamp"))
    order = Window.partitionBy(*keys).orderBy(*times)
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    # The last row that was taken in, not the row before: rows without a value don't keep an entity alive.
    last = F.last(F.when(x.isNotNull(), at), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    d = df.select(*keys, *times, x.alias(value)).withColumn("__anew", (at - last > expiry_ms * 1000).cast("int"))
    d = d.withColumn("__stretch", F.coalesce(F.sum("__anew").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    # A row without value may start a stretch, and the rows after it then start it again: nothing was known in between.
    stretch = Window.partitionBy(*keys, "__stretch").orderBy(*times)
    d = d.withColumn("known", F.count(value).over(stretch.rowsBetween(Window.unboundedPreceding, -1)))
    kept = Window.partitionBy(*keys, "__stretch", F.col(value).isNull()).orderBy(*times).rowsBetween(-keep, -1)
    place, y = F.col("known").cast("double"), F.col(value)
    n, mean_t, mean_y = F.count(y).over(kept), F.avg(place).over(kept), F.avg(y).over(kept)
    slope = F.when(n > 1, F.covar_pop(place, y).over(kept) / F.var_pop(place).over(kept)).otherwise(0.0)
    enough = (n >= least) & y.isNotNull()
    out = d.withColumns({"slope": F.when(enough, slope), "__m": mean_y, "__t": mean_t})
    return out.select(*keys, *times, value, "known", F.when(F.col("slope").isNotNull(), F.col("__m") + F.col("slope") * (place - 1 + horizon - F.col("__t"))).alias("forecast"), "slope")


def to_online_table(df: DataFrame, checkpoint: str, path: str, entity: Names, ts: str, ttl: str) -> StreamingQuery:
    """Keep the newest row of each entity, batch by batch; rows older than ``ttl`` before the newest time seen are dropped.

    Each batch writes a version and then a line in the log beside it. A batch that is repeated writes the same version again.
    """
    keys = names(entity)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.unionByName(spark.read.parquet(f"{path}/version={number - 1}")) if number else batch
        rest = [c for c in batch.columns if c not in keys]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("r")).select(*keys, "r.*")
        end = rows.agg(F.max(ts).alias("__end"))
        newest.join(F.broadcast(end)).where(F.col(ts) > F.col("__end") - F.expr(f"INTERVAL {ttl}")).drop("__end").write.mode("overwrite").parquet(f"{path}/version={number}")
        spark.range(1).select(F.lit(number).alias("number")).write.mode("append").parquet(f"{path}/log")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of :func:`to_online_table`."""
    return spark.read.parquet(f"{path}/version={spark.read.parquet(f'{path}/log').agg(F.max('number')).first()[0]}")


def lookup(asked: DataFrame, rows: DataFrame, entity: Names, ts: str, now: str, ttl: str, features: Names) -> DataFrame:
    """The asked keys with the features known of them at the time ``now`` (a column of ``asked``), and ``found``.

    Features of a row that is ``ttl`` old or older, or not there yet at that time, are null and the key isn't found, nor is a null key; a key asked twice is answered twice. No column of ``asked`` may have a feature's name.
    """
    keys, wanted = names(entity), names(features)
    held = rows.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(ts).alias("__ts"), *(F.col(c).alias(f"__f_{c}") for c in wanted))
    met = asked.join(held, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    live = F.coalesce((F.col("__ts") <= F.col(now)) & (F.col("__ts") > F.col(now) - F.expr(f"INTERVAL {ttl}")), F.lit(False))
    return met.select(*asked.columns, *(F.when(live, F.col(f"__f_{c}")).alias(c) for c in wanted), live.alias("found"))
