"""Joins in time without range joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names


def as_of(left: DataFrame, right: DataFrame, entity: Names, left_ts: str, right_ts: str, columns: list[str], max_age: str | None = None, strict: bool = False, direction: str = "backward") -> DataFrame:
    """Each left row with the right row of its entity that is nearest before it (or after it).

    Both sides go into one sorted stream, one shuffle in all, and the last right row seen is carried
    along; nothing is paired that isn't returned. ``strict`` leaves out rows of equal time. Right rows
    older than ``max_age`` give nulls. Right columns come back under their names, with ``right_ts``.
    Among right rows of equal time, the one with the greatest columns is taken.
    """
    keys = names(entity)
    ahead = direction == "forward"
    kept = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.col(left_ts).alias("__t"), F.lit(1 if strict == ahead else 0).alias("__o"), F.struct(*kept).alias("__l"), F.lit(None).cast(right.select(F.struct(right_ts, *columns)).schema[0].dataType).alias("__r"))
    b = right.select(*keys, F.col(right_ts).alias("__t"), F.lit(0 if strict == ahead else 1).alias("__o"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(right_ts, *columns).alias("__r"))
    # Of equal times, right rows come first unless the join is strict: a flag says which.
    side = F.when(F.col("__l").isNull(), 0).otherwise(1)
    flag = 1 - side if strict else side
    order = [F.col("__t").desc(), (flag).asc(), F.col("__r").asc_nulls_first()] if ahead else [F.col("__t").asc(), flag.asc(), F.col("__r").asc_nulls_first()]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    matched = both.select(*keys, "__l.*", "__m")
    if max_age:
        fresh = F.expr(f"__m.`{right_ts}` >= `{left_ts}` - interval {max_age}") if not ahead else F.expr(f"__m.`{right_ts}` <= `{left_ts}` + interval {max_age}")
        matched = matched.withColumn("__m", F.when(fresh, F.col("__m")))
    return matched.select(*keys, *kept, *(F.col(f"__m.`{c}`").alias(c) for c in (right_ts, *columns)))


def as_of_nearest(left: DataFrame, right: DataFrame, entity: Names, left_ts: str, right_ts: str, columns: list[str]) -> DataFrame:
    """The nearer of the rows before and after, the earlier one at equal distance. It looks ahead: for repair, never for features."""
    back = as_of(left, right, entity, left_ts, right_ts, columns)
    renamed = right.select(*names(entity), F.col(right_ts).alias("__n_ts"), *(F.col(c).alias(f"__n_{c}") for c in columns))
    both = as_of(back, renamed, entity, left_ts, "__n_ts", [f"__n_{c}" for c in columns], direction="forward")

    def micros(c: str):  # noqa: ANN202
        return F.unix_micros(F.col(c).cast("timestamp"))

    ahead = F.col(right_ts).isNull() | (micros("__n_ts") - micros(left_ts) < micros(left_ts) - micros(right_ts))
    take = F.coalesce(ahead & F.col("__n_ts").isNotNull(), F.lit(False))
    cols = {c: F.when(take, F.col(f"__n_{c}")).otherwise(F.col(c)) for c in columns} | {right_ts: F.when(take, F.col("__n_ts")).otherwise(F.col(right_ts))}
    return both.select(*(cols[c].alias(c) if c in cols else F.col(c) for c in back.columns))


def event_windows(rows: DataFrame, events: DataFrame, entity: Names, index: str, before: int, after: int) -> DataFrame:
    """Rows within ``before`` to ``after`` places of each event: events are spread over their places, then an equi-join."""
    keys = names(entity)
    places = events.select(*keys, F.col(index).alias("event_index"), F.explode(F.expr(f"sequence({index} - {before}, {index} + {after})")).alias(index))
    return rows.join(places, [*keys, index])


def latest(df: DataFrame, entity: Names, ts: Names) -> DataFrame:
    """The newest row of each entity, by an aggregate instead of a sort."""
    keys = names(entity)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*names(ts))).alias("__r")).select(*keys, "__r.*")


def latest_known(df: DataFrame, entity: Names, ts: str) -> DataFrame:
    """The newest value that isn't null of each column."""
    keys = names(entity)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in rest))
