"""Stateful operators: one state per entity, over streams (``transformWithStateInPandas``) or, one series at a time, over tables.

Each detector is a small class with ``update(value) -> tuple`` and a state that is a tuple of numbers,
so the same code runs in a stream and in a batch. Rows of a micro-batch are put in order of time first.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronolake.functions.windows import Names, names


class Detector:
    """State is ``self.state``; ``outputs`` names what ``update`` returns."""

    outputs: tuple[str, ...] = ()
    start: tuple[float, ...] = ()

    def __init__(self, state: tuple[float, ...] | None = None) -> None:
        self.state = tuple(state) if state is not None else self.start

    def update(self, x: float) -> tuple[float, ...]:
        raise NotImplementedError


class RunningZ(Detector):
    """Mean and z-score after each value, from count, mean and sum of squares."""

    outputs, start = ("mean", "z"), (0.0, 0.0, 0.0)

    def update(self, x: float) -> tuple[float, ...]:
        n, mean, m2 = self.state
        n += 1
        step = x - mean
        mean += step / n
        m2 += step * (x - mean)
        self.state = (n, mean, m2)
        sd = math.sqrt(m2 / (n - 1)) if n > 1 else 0.0
        return mean, (x - mean) / sd if sd > 0 else 0.0


class ForgettingZ(Detector):
    """z-score with weights that fall by ``decay`` a step; the value is scored before it is learnt."""

    outputs, start, decay = ("z",), (0.0, 0.0, 0.0), 0.98

    def update(self, x: float) -> tuple[float, ...]:
        w, mean, var = self.state
        sd = math.sqrt(var / w) if w > 1 else 0.0
        z = (x - mean) / sd if sd > 0 else 0.0
        w = w * self.decay + 1
        step = x - mean
        mean += step / w
        self.state = (w, mean, var * self.decay + step * (x - mean))
        return (z,)


class Cusum(Detector):
    """Two-sided sums against a known mean and deviation; ``reset`` empties both after an alarm."""

    outputs, start = ("s_hi", "s_lo", "alarm"), (0.0, 0.0)
    mean, sd, k, h, reset = 0.0, 1.0, 0.5, 5.0, True

    def update(self, x: float) -> tuple[float, ...]:
        z = (x - self.mean) / self.sd
        hi, lo = max(0.0, self.state[0] + z - self.k), max(0.0, self.state[1] - z - self.k)
        alarm = max(hi, lo) > self.h
        self.state = (0.0, 0.0) if alarm and self.reset else (hi, lo)
        return hi, lo, float(alarm)


class Adwin(Detector):
    """A window that drops its older part when the means of two parts differ more than chance allows.

    The state is the window as exponential buckets (Bifet and Gavalda 2007): sizes are powers of two, no more than ``per_size``
    of a size, so it grows with the logarithm of the window and no value is left out. Cuts lie between
    buckets. State: rows, then (rows, sum, sum of squares) of each bucket, the oldest first.
    """

    outputs, start = ("mean", "width", "change"), ()
    #: ``bound`` "variance" allows for the window's own variance, "hoeffding" for any values between 0 and 1.
    delta, per_size, least, bound = 0.002, 5, 5, "variance"

    def update(self, x: float) -> tuple[float, ...]:
        s = self.state
        buckets = [list(s[i : i + 3]) for i in range(0, len(s), 3)]
        buckets.append([1.0, x, x * x])
        size, end = 1.0, len(buckets)
        while True:
            same = [i for i in range(end) if buckets[i][0] == size]
            if len(same) <= self.per_size:
                break
            i = same[0]
            buckets[i] = [a + b for a, b in zip(buckets[i], buckets[i + 1], strict=True)]
            del buckets[i + 1]
            size, end = 2 * size, len(buckets)
        changed = False
        n, total, squares = (sum(b[k] for b in buckets) for k in range(3))
        while n >= 2 * self.least:
            var = max(squares / n - (total / n) ** 2, 0.0)
            log = math.log(2 * math.log(n) / self.delta)
            left = head = 0.0
            cut = 0
            for i, b in enumerate(buckets[:-1]):
                left, head = left + b[0], head + b[1]
                if left < self.least or n - left < self.least:
                    continue
                m = 1 / (1 / left + 1 / (n - left))
                if self.bound == "hoeffding":
                    chance = math.sqrt(math.log(4 * n * n / self.delta) / (2 * m))
                else:
                    chance = math.sqrt(2 / m * var * log) + 2 / (3 * m) * log
                if abs(head / left - (total - head) / (n - left)) > chance:
                    cut = i + 1
            if not cut:
                break
            buckets, changed = buckets[cut:], True
            n, total, squares = (sum(b[k] for b in buckets) for k in range(3))
        self.state = tuple(v for b in buckets for v in b)
        return total / n, n, float(changed)


class FadingZ(Detector):
    """z-score after the value is learnt, weights falling by ``decay`` a step; the deviation's denominator is w - w / n."""

    outputs, start, decay = ("mean", "z"), (0.0, 0.0, 0.0, 0.0), 0.98

    def update(self, x: float) -> tuple[float, ...]:
        n, w, mean, m = self.state
        n, w = n + 1, self.decay * w + 1
        step = x - mean
        mean += step / w
        m = self.decay * m + step * (x - mean)
        self.state = (n, w, mean, m)
        sd = math.sqrt(max(m / (w - w / n), 1e-12)) if n > 1 else 1.0
        return mean, (x - mean) / (sd + 1e-12)


class VitalMonitor(Detector):
    """Exponentially weighted mean and variance of a vital sign; the value is scored before it is learnt, and the alert is 0, 1 (warning) or 2 (critical)."""

    outputs, start = ("z", "alert"), (0.0, 0.0, 0.0)
    rate, warn, critical, least = 0.1, 2.5, 4.0, 5

    def update(self, x: float) -> tuple[float, ...]:
        n, mean, var = self.state
        z = (x - mean) / math.sqrt(var + 1e-6) if n >= self.least else 0.0
        if not n:
            self.state = (1.0, x, 0.0)
        else:
            step = x - mean
            self.state = (n + 1, mean + self.rate * step, (1 - self.rate) * (var + self.rate * step * step))
        return z, float((abs(z) > self.warn) + (abs(z) > self.critical))


class LearntCusum(Detector):
    """Two-sided sums against mean and deviation of the first ``learn`` values; both start anew after an alarm."""

    outputs, start = ("s_hi", "s_lo", "alarm"), (0.0, 0.0, 0.0, 0.0, 0.0)
    learn, k, h = 30, 0.5, 5.0

    def update(self, x: float) -> tuple[float, ...]:
        n, mean, m2, hi, lo = self.state
        if n < self.learn:
            n += 1
            step = x - mean
            mean += step / n
            self.state = (n, mean, m2 + step * (x - mean), 0.0, 0.0)
            return 0.0, 0.0, 0.0
        z = (x - mean) / (math.sqrt(m2 / n) + 1e-12)
        hi, lo = max(0.0, hi + z - self.k), max(0.0, lo - z - self.k)
        alarm = max(hi, lo) > self.h
        self.state = (n, mean, m2, 0.0 if alarm else hi, 0.0 if alarm else lo)
        return hi, lo, float(alarm)


class OnlineConformal(Detector):
    """For a stream of absolute residuals: a width that grows after a miss and shrinks after a hit, so that a share ``alpha`` misses in the long run."""

    outputs, start = ("width", "missed"), (0.0, 0.0)
    alpha, rate = 0.1, 0.05

    def update(self, x: float) -> tuple[float, ...]:
        n, width = self.state
        if not n:
            self.state = (1.0, abs(x))
            return abs(x), 0.0
        missed = float(abs(x) > width)
        scale = max(abs(x), width, 1e-12)
        self.state = (n + 1, max(0.0, width + self.rate * scale * (missed - self.alpha)))
        return width, missed


class Histogram(Detector):
    """Score from a decaying histogram: the rarer the value's bin, the higher."""

    outputs, bins, low, high, decay = ("score",), 20, 0.0, 200.0, 0.99
    start = (0.0,) * 20

    def update(self, x: float) -> tuple[float, ...]:
        i = min(self.bins - 1, max(0, int((x - self.low) / (self.high - self.low) * self.bins)))
        total = sum(self.state)
        score = -math.log((self.state[i] + 1e-3) / (total + self.bins * 1e-3))
        counts = [c * self.decay for c in self.state]
        counts[i] += 1
        self.state = tuple(counts)
        return (score,)


class DensityHistogram(Detector):
    """Score from a histogram over what the first ``warmup`` values span and ``margin`` more on both sides: the log of one over the density at the value.

    Counts fade by ``alpha`` a step, and a value counts after it is scored; values beyond the ends are in the bins there. The first values score 0.
    State: rows, low, high, then the values kept for the start or the counts.
    """

    outputs, start = ("score",), (0.0, 0.0, 0.0)
    bins, alpha, warmup, margin = 20, 0.005, 50, 1.0

    def update(self, x: float) -> tuple[float, ...]:
        t, low, high, kept = self.state[0] + 1, *self.state[1:3], list(self.state[3:])
        if t <= self.warmup:
            kept.append(x)
            if t == self.warmup:
                low, high = min(kept) - self.margin, max(kept) + self.margin
                first = [self._bin(v, low, high) for v in kept]
                kept = [first.count(i) + 1e-6 for i in range(self.bins)]
            self.state = (t, low, high, *kept)
            return (0.0,)
        i = self._bin(x, low, high)
        density = kept[i] / (sum(kept) * ((high - low) / self.bins + 1e-12))
        kept = [c * (1 - self.alpha) for c in kept]
        kept[i] += 1
        self.state = (t, low, high, *kept)
        return (-math.log(density + 1e-12),)

    def _bin(self, v: float, low: float, high: float) -> int:
        return min(self.bins - 1, max(0, math.ceil((v - low) / (high - low) * self.bins) - 1))


class DetectorPipeline(Detector):
    """Spikes and drift together: fading z-score, adaptive window, histogram after 30 values, smoothed |z|, alerts with a cooldown.

    State: rows, row of the last alert, low and high of the histogram, its 20 counts, the z-score's four numbers, the count
    of the smoothing buffer and its five places, then the adaptive window's buckets or, till the histogram begins, also the
    values it will be made of.
    """

    outputs = ("z", "smoothed_z", "histogram", "alert", "drift", "window_mean")
    most, warmup, bins, size, cooldown, decay = 3.5, 30, 20, 5, 10, 0.99
    start = (0.0, -10.0, 0.0, 0.0, *(0.0,) * 20, *(0.0,) * 4, 0.0, *(0.0,) * 5, 0.0)

    def update(self, x: float) -> tuple[float, ...]:
        t, last, low, high = self.state[:4]
        counts, spot, held = list(self.state[4:24]), self.state[24:28], int(self.state[28])
        recent, waiting = list(self.state[29 : 29 + held]), int(self.state[34])
        early, buckets = list(self.state[35 : 35 + waiting]), self.state[35 + waiting :]
        t += 1
        fading = FadingZ(spot)
        fading.decay = self.decay
        z = fading.update(x)[1]
        window = Adwin(buckets)
        mean, _, drift = window.update(x)
        rarity = 0.0
        if t <= self.warmup:
            early.append(x)
        if t == self.warmup:
            low, high = min(early), max(early)
            for v in early:
                counts[self._bin(v, low, high)] += 1
            early = []
        if t >= self.warmup:
            i = self._bin(x, low, high)
            rarity = -math.log((counts[i] + 1e-3) / (sum(counts) + self.bins * 1e-3))
            counts[i] += 1
        recent = [*recent, abs(z)][-self.size :]
        smoothed = sum(recent) / len(recent)
        alert = smoothed > self.most and t - last >= self.cooldown
        last = t if alert else last
        self.state = (t, last, low, high, *counts, *fading.state, float(len(recent)), *recent, *(0.0,) * (self.size - len(recent)), float(len(early)), *early, *window.state)
        return z, smoothed, rarity, float(alert), drift, mean

    def _bin(self, v: float, low: float, high: float) -> int:
        return min(self.bins - 1, max(0, int((v - low) / (high - low) * self.bins))) if high > low else 0


class HalfSpaces(Detector):
    """Score from the mass profile of a half-space tree over known bounds: little mass on the value's path, high score.

    Values are counted in the current window; when it is full its masses become the reference ones. State: rows, then the
    reference and the current masses of all nodes below the root, level by level. Nothing is scored in the first window.
    """

    outputs, depth, window, low, high = ("score",), 6, 250, 0.0, 1.0
    start = (0.0,) * (1 + 2 * (2**7 - 2))

    def update(self, x: float) -> tuple[float, ...]:
        nodes = 2 ** (self.depth + 1) - 2
        n, reference, current = self.state[0] + 1, list(self.state[1 : 1 + nodes]), list(self.state[1 + nodes :])
        share = min(max((x - self.low) / (self.high - self.low), 0.0), 1.0)
        mass = 0.0
        for level in range(1, self.depth + 1):
            at = 2**level - 2 + min(2**level - 1, int(share * 2**level))
            mass += reference[at] * 2**level
            current[at] += 1
        if n % self.window == 0:
            reference, current = current, [0.0] * nodes
        score = 1 / (mass + 1) if n > self.window else 0.0
        self.state = (n, *reference, *current)
        return (score,)


class OnlineMean(Detector):
    """A forecaster that learns as it goes: predicts, then moves its level towards the value."""

    outputs, start, rate = ("prediction", "error"), (0.0, 0.0), 0.1

    def update(self, x: float) -> tuple[float, ...]:
        n, level = self.state
        prediction = level if n else x
        self.state = (n + 1, prediction + self.rate * (x - prediction))
        return prediction, x - prediction


def _schema(df: DataFrame, keys: list[str], ts: str, value: str, d: type[Detector]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in [*keys, ts]), f"`{value}` double", *(f"`{o}` double" for o in d.outputs)])


def over_table(df: DataFrame, entity: Names, ts: str, value: str, detector: type[Detector]) -> DataFrame:
    """The detector along each entity of a table, in order of time."""
    keys = names(entity)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(ts)[[*keys, ts, value]]
        d = detector()
        rows = [d.update(float(x)) for x in pdf[value]]
        return pdf.assign(**{value: pdf[value].astype(float)}, **{o: [r[i] for r in rows] for i, o in enumerate(detector.outputs)})

    return df.select(*keys, ts, value).groupBy(*keys).applyInPandas(run, _schema(df, keys, ts, value, detector))


def processor(keys: list[str], ts: str, value: str, detector: type[Detector]) -> StatefulProcessor:
    """The detector as a processor whose state is an array of numbers."""

    class Keyed(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.kept = handle.getValueState("state", "x array<double>")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            d = detector(tuple(self.kept.get()[0]) if self.kept.exists() else None)
            pdf = pd.concat(list(rows)).sort_values(ts)
            made = [d.update(float(x)) for x in pdf[value]]
            self.kept.update((list(d.state),))
            yield pd.DataFrame({**dict(zip(keys, ([k] * len(pdf) for k in key), strict=True)), ts: pdf[ts].to_numpy(), value: pdf[value].astype(float).to_numpy(), **{o: [r[i] for r in made] for i, o in enumerate(detector.outputs)}})

        def close(self) -> None:
            """Nothing is held besides the state."""

    return Keyed()


def over_stream(df: DataFrame, entity: Names, ts: str, value: str, detector: type[Detector]) -> DataFrame:
    """The detector over a stream, its state kept by key in the state store (RocksDB has to be its provider)."""
    keys = names(entity)
    return df.select(*keys, ts, value).groupBy(*keys).transformWithStateInPandas(processor(keys, ts, value, detector), _schema(df, keys, ts, value, detector), "Append", "None")


def pandas_state(keys: list[str], ts: str, value: str, detector: type[Detector]) -> Callable:
    """The same for ``applyInPandasWithState``, where the state store is another."""

    def run(key: tuple, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        d = detector(tuple(state.get[0]) if state.exists else None)
        pdf = pd.concat(list(rows)).sort_values(ts)
        made = [d.update(float(x)) for x in pdf[value]]
        state.update((list(d.state),))
        yield pd.DataFrame({**dict(zip(keys, ([k] * len(pdf) for k in key), strict=True)), ts: pdf[ts].to_numpy(), value: pdf[value].astype(float).to_numpy(), **{o: [r[i] for r in made] for i, o in enumerate(detector.outputs)}})

    return run


def over_stream_with_pandas_state(df: DataFrame, entity: Names, ts: str, value: str, detector: type[Detector]) -> DataFrame:
    from pyspark.sql.streaming.state import GroupStateTimeout

    keys = names(entity)
    return df.select(*keys, ts, value).groupBy(*keys).applyInPandasWithState(pandas_state(keys, ts, value, detector), _schema(df, keys, ts, value, detector), "x array<double>", "append", GroupStateTimeout.NoTimeout)
