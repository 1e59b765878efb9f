"""Models on tables: MLlib where it has the model, least squares from aggregated moments where it hasn't."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronolake.functions.windows import Names, names
from chronolake.operators.stats import moments

REGRESSORS = {
    "ridge": lambda **k: LinearRegression(regParam=0.1, elasticNetParam=0.0, **k),
    "lasso": lambda **k: LinearRegression(regParam=0.1, elasticNetParam=1.0, **k),
    "elastic_net": lambda **k: LinearRegression(regParam=0.1, elasticNetParam=0.5, **k),
    "forest": lambda **k: RandomForestRegressor(numTrees=30, maxDepth=6, seed=42, **k),
    "boosted": lambda **k: GBTRegressor(maxIter=30, maxDepth=4, seed=42, **k),
}


def regressor(kind: str, columns: Sequence[str], label: str) -> Pipeline:
    """Columns scaled by what the training rows have, then the model. Fit it on training rows only."""
    raw = VectorAssembler(inputCols=list(columns), outputCol="__raw", handleInvalid="skip")
    scaled = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True)
    return Pipeline(stages=[raw, scaled, REGRESSORS[kind](featuresCol="__x", labelCol=label, predictionCol="prediction")])


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("__raw", "__x")


def importance(model: PipelineModel, columns: Sequence[str]) -> dict[str, float]:
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    return dict(zip(columns, map(float, values), strict=True))


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], label: str, seed: int = 42) -> dict[str, float]:
    """Growth of the error when a column's values are dealt to other rows (by a join on shuffled row numbers)."""

    def error(d: DataFrame) -> float:
        return predicted(model, d).agg(F.avg(F.abs(F.col("prediction") - F.col(label)))).first()[0]

    base = error(df)
    order = df.withColumn("__r", F.rand(seed)).withColumn("__b", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    out = {}
    for c in columns:
        w = Window.partitionBy("__b").orderBy("__r")
        out[c] = error(order.withColumn(c, F.coalesce(F.lead(c).over(w), F.col(c))).drop("__r", "__b")) - base
    return out


def out_of_fold(df: DataFrame, folds: Sequence[tuple[int, int, int, int]], t: str, columns: Sequence[str], label: str, kinds: Sequence[str]) -> DataFrame:
    """Predictions of each kind for the test rows of each fold, made by models that saw the fold's training rows alone: input for a stack."""
    parts = []
    for a, b, c, d in folds:
        test = df.where(F.col(t).between(c, d - 1))
        for kind in kinds:
            test = predicted(regressor(kind, columns, label).fit(df.where(F.col(t).between(a, b - 1))), test).withColumnRenamed("prediction", f"p_{kind}")
        parts.append(test)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blend_weights(df: DataFrame, predictions: Sequence[str], label: str) -> dict[str, float]:
    """Weights of least squared error that aren't negative and sum to 1, from the columns' moments."""
    m, _ = moments(df, [label, *predictions])
    m = np.array(m)
    a, b = m[2:, 2:], m[2:, 1]
    w = np.full(len(predictions), 1 / len(predictions))
    step = 1 / max(np.linalg.eigvalsh(a)[-1], 1e-12)
    for _ in range(5_000):
        v = w - step * (a @ w - b)
        # onto the simplex
        u = np.sort(v)[::-1]
        k = np.arange(1, len(u) + 1)
        rho = k[u + (1 - np.cumsum(u)) / k > 0][-1]
        w = np.maximum(v + (1 - u[:rho].sum()) / rho, 0)
    return dict(zip(predictions, map(float, w), strict=True))


def vector_autoregression(df: DataFrame, ts: str, channels: Sequence[str], lag: int) -> np.ndarray:
    """Coefficients (channels x (1 + channels * lag), intercept first, then lag 1 of all channels, ...) by least squares on one aggregate."""
    w = Window.orderBy(ts)
    cols = [f"{c}__{k}" for k in range(1, lag + 1) for c in channels]
    d = df.select(*channels, *(F.lag(c, k).over(w).alias(f"{c}__{k}") for k in range(1, lag + 1) for c in channels))
    m, _ = moments(d, [*channels, *cols])
    m = np.array(m)
    x = [0, *range(1 + len(channels), len(m))]
    return np.linalg.lstsq(m[np.ix_(x, x)], m[np.ix_(x, range(1, 1 + len(channels)))], rcond=None)[0].T


def var_forecast(coef: np.ndarray, last: np.ndarray, horizon: int) -> np.ndarray:
    """``last`` has the latest rows, newest last."""
    n, lag = len(coef), (coef.shape[1] - 1) // len(coef)
    rows = list(last[-lag:])
    for _ in range(horizon):
        rows.append(coef[:, 0] + coef[:, 1:] @ np.concatenate([rows[-k] for k in range(1, lag + 1)]))
    return np.array(rows[lag:]).reshape(horizon, n)


def impulse_responses(coef: np.ndarray, horizon: int) -> np.ndarray:
    """Responses (horizon + 1, channel, shock) to unit shocks, from the moving-average form."""
    n, lag = len(coef), (coef.shape[1] - 1) // len(coef)
    a = [coef[:, 1 + k * n : 1 + (k + 1) * n] for k in range(lag)]
    out = [np.eye(n)]
    for h in range(1, horizon + 1):
        out.append(sum(out[h - k - 1] @ a[k] for k in range(min(h, lag))))
    return np.array(out)


def clusters(df: DataFrame, array: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by k-means on an array column."""
    d = df.withColumn("__v", array_to_vector(F.col(array).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(d).transform(d).drop("__v")


def best_k(df: DataFrame, array: str, candidates: Sequence[int], seed: int = 42) -> tuple[int, dict[int, float]]:
    """The number of clusters of greatest silhouette, and the silhouette of each."""
    d = df.withColumn("__v", array_to_vector(F.col(array).cast("array<double>"))).cache()
    scores = {k: ClusteringEvaluator(featuresCol="__v", predictionCol="c").evaluate(KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="c").fit(d).transform(d)) for k in candidates}
    d.unpersist()
    return max(scores, key=scores.get), scores


def linked_clusters(df: DataFrame, array: str, k: int, centres: int = 100, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by average linkage, cut at ``k`` clusters.

    Linkage needs all distances, so what is linked is k-means centres, each with the weight of its rows: their number is a
    parameter, whatever the number of rows. With fewer rows than centres it is the linkage of the rows themselves.
    """
    d = df.withColumn("__v", array_to_vector(F.col(array).cast("array<double>")))
    model = KMeans(k=centres, seed=seed, featuresCol="__v", predictionCol="__c").fit(d)
    placed, middle = model.transform(d), np.array(model.clusterCenters())
    weight = np.zeros(len(middle))
    for r in placed.groupBy("__c").count().collect():
        weight[r["__c"]] = r["count"]
    group, size = np.arange(len(middle)), weight.copy()
    far = np.sqrt(((middle[:, None] - middle[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    alive = weight > 0
    far[~alive], far[:, ~alive] = np.inf, np.inf
    while alive.sum() > k:
        i, j = sorted(map(int, np.unravel_index(np.argmin(far), far.shape)))
        far[i] = far[:, i] = (size[i] * far[i] + size[j] * far[j]) / (size[i] + size[j])
        far[i, i], far[j], far[:, j], alive[j] = np.inf, np.inf, np.inf, False
        size[i] += size[j]
        group[group == j] = i
    number = {g: n for n, g in enumerate(np.flatnonzero(alive).tolist())}
    names_ = F.create_map(*(F.lit(x) for c, g in enumerate(group.tolist()) if g in number for x in (c, number[g])))
    return placed.withColumn("cluster", names_[F.col("__c")]).drop("__v", "__c")


def shape_clusters(df: DataFrame, array: str, k: int, rounds: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by shape: series of one length, scaled to mean 0 and deviation 1, nearest by cross-correlation at the best shift.

    A cluster's shape is the first eigenvector of the products of its members, each shifted towards the last shape. The
    products add up, so a task gives one matrix a cluster and the driver sums them; the members never meet in one place.
    Starts from a hash of the series. A series without spread is zero everywhere and goes to the first cluster.
    """
    width = df.select(F.max(F.size(array))).first()[0] or 0
    start = np.random.default_rng(seed).integers(0, k, 1 << 16)

    def scaled(x: pd.Series) -> np.ndarray:
        a = np.array(x.tolist(), float).reshape(len(x), width)
        a = a - a.mean(1, keepdims=True)
        return a / np.maximum(a.std(1, keepdims=True), 1e-12)

    def placed(a: np.ndarray, shapes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and shifted copy of each row."""
        if shapes is None:
            return start[(np.abs(a * np.arange(1, width + 1)).sum(1) * 7919).astype(np.int64) % len(start)], a
        n = 1 << (2 * width).bit_length()
        cross = np.fft.irfft(np.fft.rfft(shapes, n)[None] * np.conj(np.fft.rfft(a, n))[:, None], n)
        shifts = np.r_[0:width, -width + 1 : 0]
        best = cross[:, :, shifts]
        where = best.reshape(len(a), -1).argmax(1)
        c, s = where // len(shifts), shifts[where % len(shifts)]
        at = np.arange(width)[None] - s[:, None]
        return c, np.where((at >= 0) & (at < width), np.take_along_axis(a, np.clip(at, 0, width - 1), 1), 0.0)

    shapes = None
    for _ in range(rounds if width else 0):

        def products(batches: Iterator[pd.DataFrame], shapes: np.ndarray | None = shapes) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, width + 1, width))
            for b in batches:
                if len(b):
                    c, moved = placed(scaled(b["x"]), shapes)
                    for g in np.unique(c):
                        total[g] += np.vstack([moved[c == g].T @ moved[c == g], moved[c == g].sum(0)])
            yield pd.DataFrame({"c": np.arange(k), "m": [x.ravel() for x in total]})

        sums = df.select(F.col(array).cast("array<double>").alias("x")).where("x is not null").mapInPandas(products, "c int, m array<double>")
        summed = sums.select("c", F.posexplode("m").alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros((k, width * (width + 1)))
        total[summed["c"], summed["i"]] = summed["v"]
        level = np.eye(width) - 1 / width
        total = total.reshape(k, width + 1, width)
        shapes = np.array([np.linalg.eigh(level @ x[:-1] @ level)[1][:, -1] for x in total])
        # An eigenvector has no sign of its own: that of the members' sum.
        shapes *= np.where((shapes * total[:, -1]).sum(1) < 0, -1, 1)[:, None]
    final = shapes

    @F.pandas_udf("int")
    def assign(x: pd.Series) -> pd.Series:
        known = x.notna().to_numpy()
        out = pd.Series([None] * len(x), dtype="Int32")
        if known.any() and width:
            out[known] = placed(scaled(x[known]), final)[0].astype(np.int32)
        return out

    return df.withColumn("cluster", assign(F.col(array).cast("array<double>")))


def reloaded(model: PipelineModel, path: str) -> PipelineModel:
    """The model as read from what is written: what a serving job gets."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def k_anonymous(df: DataFrame, entity: str, ts: str, value: str, vectors: DataFrame, array: str, k: int) -> DataFrame:
    """Values replaced by their cluster's mean at each time; entities of clusters with fewer than ``k`` are left out."""
    n = vectors.count()
    c = clusters(vectors, array, max(2, n // (2 * k))).select(entity, "cluster")
    size = c.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("cluster")
    d = df.join(c, entity).join(size, "cluster")
    means = d.groupBy("cluster", ts).agg(F.avg(value).alias(f"{value}_mean"))
    return d.join(means, ["cluster", ts]).drop("cluster", value)


def mixture_threshold(df: DataFrame, score: str, seed: int = 42) -> float:
    """Half-way point between the two parts of a Gaussian mixture of scores."""
    d = VectorAssembler(inputCols=[score], outputCol="__v").transform(df.select(F.col(score).cast("double")).na.drop())
    g = GaussianMixture(k=2, seed=seed, featuresCol="__v").fit(d).gaussiansDF.collect()
    return float(np.mean([r["mean"].toArray()[0] for r in g]))


def calibrated(train: DataFrame, df: DataFrame, label: str, score: str, how: str = "isotonic") -> DataFrame:
    """Adds ``p``: a monotone (isotonic) or logistic map from scores to probabilities."""
    if how == "isotonic":
        m = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="p").fit(train)
        return m.transform(df)
    v = VectorAssembler(inputCols=[score], outputCol="__v")
    m = LogisticRegression(featuresCol="__v", labelCol=label).fit(v.transform(train))
    return m.transform(v.transform(df)).withColumn("p", vector_to_array("probability")[1]).drop("__v", "rawPrediction", "probability", "prediction")


def feature_classifier(columns: Sequence[str], label: str) -> Pipeline:
    """Missing values by their median, then a random forest."""
    filled = [f"{c}__f" for c in columns]
    return Pipeline(stages=[Imputer(inputCols=list(columns), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="__x"), RandomForestClassifier(featuresCol="__x", labelCol=label, numTrees=30, seed=42)])


def model_confidence_set(losses: DataFrame, by: Names, rounds: int = 500, alpha: float = 0.1, seed: int = 42) -> list[str]:
    """Models (columns besides ``by``) that can't be told from the best, by bootstrap elimination. Losses are averaged by ``by`` first."""
    models = [c for c in losses.columns if c not in names(by)]
    x = losses.groupBy(*names(by)).agg(*(F.avg(m).alias(m) for m in models)).orderBy(*names(by)).select(*models).toPandas().to_numpy(float)
    rng, left = np.random.default_rng(seed), list(range(len(models)))
    picks = rng.integers(0, len(x), (rounds, len(x)))
    while len(left) > 1:
        d = x[:, left] - x[:, left].mean(1, keepdims=True)
        mean = d.mean(0)
        boot = np.stack([d[p].mean(0) for p in picks]) - mean
        t = mean / (boot.std(0) + 1e-12)
        if ((boot / (boot.std(0) + 1e-12)).max(1) >= t.max()).mean() >= alpha:
            break
        left.pop(int(t.argmax()))
    return [models[i] for i in left]
