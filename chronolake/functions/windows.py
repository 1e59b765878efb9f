"""Window frames over a series, with the number of values that a result needs.

Frames count rows, so a series has to be regular where "7 rows" should mean "7 days": lay it on a
spine first (see ``operators.spine``). Every function takes the entity columns and the order columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

Names = Sequence[str] | str


def names(x: Names) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def series(entity: Names, ts: Names) -> WindowSpec:
    """Rows of an entity in the order of time."""
    return Window.partitionBy(*names(entity)).orderBy(*names(ts))


def whole(entity: Names) -> WindowSpec:
    return Window.partitionBy(*names(entity))


def trailing(entity: Names, ts: Names, size: int) -> WindowSpec:
    """The row itself and the ``size - 1`` before it."""
    return series(entity, ts).rowsBetween(-(size - 1), 0)


def shifted(entity: Names, ts: Names, size: int, gap: int = 1) -> WindowSpec:
    """``size`` rows that end ``gap`` rows before the row itself, so that nothing leaks from it."""
    return series(entity, ts).rowsBetween(-(size + gap - 1), -gap)


def centred(entity: Names, ts: Names, size: int) -> WindowSpec:
    """A centred window; an even one reaches one row further back than ahead."""
    return series(entity, ts).rowsBetween(-(size // 2), (size - 1) // 2)


def expanding(entity: Names, ts: Names, gap: int = 0) -> WindowSpec:
    return series(entity, ts).rowsBetween(Window.unboundedPreceding, -gap)


def following(entity: Names, ts: Names) -> WindowSpec:
    return series(entity, ts).rowsBetween(0, Window.unboundedFollowing)


def gated(fn: Callable[[Column], Column], value: Column | str, frame: WindowSpec, least: int = 1) -> Column:
    """``fn(value)`` over the frame, null where the frame holds fewer than ``least`` values."""
    c = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(c).over(frame) >= least, fn(c).over(frame))


def missing_to_null(c: Column) -> Column:
    """NaN as null: Spark's aggregates skip nulls, not NaN."""
    return F.when(~F.isnan(c), c)
