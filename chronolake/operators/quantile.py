"""Exact quantiles by group without one task for a group.

A sketch brackets each quantile's rank; only the values inside the brackets are counted and ranked,
those below are only counted. So a group that holds a third of all rows is counted by every task and
ranked from some ten thousandth of its distinct values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names
from chronolake.session import written

#: The sketch's accuracy: a rank is wrong by a share of 1 / ACCURACY at most.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, by: Names, value: Column | str, levels: Sequence[float], name: str = "q", more: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """The columns of ``by`` and an array ``name`` with the value at each level, linear between ranks; nulls are left out.

    A group without values has no row. ``by`` may be empty. ``more`` names aggregates of the values that the sketch's scan makes along with it;
    the sketch, one row a group, is then written at once.
    """
    keys = names(by)
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    d = df.select(*keys, v.alias("__v")).where("__v is not null")
    # Twice the sketch's error on both sides; ranks next to the ends are bracketed by the least and greatest value.
    sure = 2.0 / ACCURACY
    low, high = [max(0.0, p - sure) for p in levels], [min(1.0, p + sure) for p in levels]
    sketch = d.groupBy(*keys).agg(F.percentile_approx("__v", [*low, *high], ACCURACY).alias("__s"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.count("__v").alias("__n"), *(f("__v").alias(c) for c, f in (more or {}).items()))
    if more:
        sketch = written(sketch, "sketch")
    few = sketch.select(*keys, "__n", *(F.when((F.col("__n") < ACCURACY) | F.lit(p <= sure), F.col("__min")).otherwise(F.col("__s")[i]).alias(f"__l{i}") for i, p in enumerate(levels)), *(F.when((F.col("__n") < ACCURACY) | F.lit(p >= 1 - sure), F.col("__max")).otherwise(F.col("__s")[len(levels) + i]).alias(f"__h{i}") for i, p in enumerate(levels)))
    joined = d.join(few, keys) if keys else d.join(F.broadcast(few))
    x = F.col("__v")
    # A value inside a bracket goes on as itself, one below as a null that is only counted.
    slots = F.array(*(F.when(x <= F.col(f"__h{i}"), F.struct(F.lit(i).alias("i"), F.when(x >= F.col(f"__l{i}"), x).alias("v"))) for i in range(len(levels))))
    counted = joined.select(*keys, "__n", F.explode(slots).alias("s")).where("s is not null").groupBy(*keys, "s.i", "s.v").agg(F.count(F.lit(1)).alias("c"), F.max("__n").alias("n"))
    w = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("v"))
    upto = counted.withColumn("upto", F.sum("c").over(w)).where("v is not null")
    at = F.element_at(F.array(*map(F.lit, levels)), F.col("i") + 1) * (F.col("n") - 1)
    first, last = F.floor(at), F.ceil(at)

    def value_at(place: Column) -> Column:
        return F.max(F.when((F.col("upto") > place) & (F.col("upto") - F.col("c") <= place), F.col("v")))

    one = upto.groupBy(*keys, "i").agg(value_at(first).alias("a"), value_at(last).alias("b"), F.max(at - first).alias("part"))
    row = F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q"))
    out = one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["q"]).alias(name))
    if not more:
        return out
    extra = sketch.select(*keys, *more)
    return out.join(extra, keys) if keys else out.join(F.broadcast(extra))
