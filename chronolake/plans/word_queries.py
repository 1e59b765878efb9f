"""Queries of symbolic Fourier words over vectors taken as series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.operators import words
from chronolake.plans.catalog import query, rounded, table
from chronolake.session import written

WINDOW, LENGTH, LETTERS = 16, 4, 4
SHAPE = (WINDOW, LENGTH, LETTERS)


def _sum(weights: list[float]) -> str:
    return "(" + " + ".join(f"s[{t + 1}] * ({w!r}::DOUBLE)" for t, w in enumerate(weights)) + ")"


_COEFFICIENTS = ", ".join(f"round(CASE WHEN sd > 1e-9 THEN {_sum(w)} / sd ELSE 0 END, 9)" for w in words.basis(WINDOW, LENGTH))
_EDGES = f"""
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), w AS (SELECT vec_id, label, i, x[i:i + {WINDOW - 1}] AS s FROM (SELECT *, unnest(range(1, len(x) - {WINDOW - 2})) AS i FROM e) u),
c AS MATERIALIZED (SELECT vec_id, label, i, [{_COEFFICIENTS}] AS c FROM (SELECT *, list_aggregate(s, 'stddev_pop') AS sd FROM w) y),
p AS (SELECT unnest(range(0, {LENGTH})) AS place, unnest(c) AS v FROM c), edges AS MATERIALIZED (SELECT place, quantile_cont(v, [{", ".join(str(k / LETTERS) for k in range(1, LETTERS))}]) AS edges FROM p GROUP BY 1)"""
_WORD = " + ".join(f"{LETTERS**k} * len(list_filter((SELECT edges FROM edges WHERE place = {k}), lambda g: c[{k + 1}] > g))" for k in range(LENGTH))
_BAGS = f"""{_EDGES},
s AS (SELECT vec_id, label, i, {_WORD} AS word FROM c), b AS MATERIALIZED (SELECT vec_id, label, word, count(*) AS n FROM (SELECT *, lag(word) OVER (PARTITION BY vec_id ORDER BY i) AS was FROM s) t WHERE was IS NULL OR was <> word GROUP BY 1, 2, 3)"""


def spelled(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return words.words(e, "x", written(words.letter_edges(e, "x", *SHAPE), "edges"), *SHAPE)


@query(f"WITH {_EDGES} SELECT place, k AS edge, round(edges[k], 6) + 0.0 AS value FROM (SELECT *, unnest(range(1, {LETTERS})) AS k FROM edges) u")
def fourier_letter_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("embedding").cast("array<double>").alias("x"))
    edges = words.letter_edges(e, "x", *SHAPE).select("place", F.posexplode("edges").alias("edge", "value"))
    return rounded(edges.select("place", (F.col("edge") + 1).alias("edge"), "value"))


@query(f"WITH {_BAGS} SELECT vec_id, word, n FROM b")
def fourier_word_bags(spark: SparkSession, d: str) -> DataFrame:
    return words.bags(spelled(spark, d), "vec_id")


@query(f"""
WITH {_BAGS}, t AS (SELECT label, word, sum(n) AS n FROM b WHERE vec_id % 5 <> 0 GROUP BY 1, 2), h AS (SELECT word, count(*) AS df FROM t GROUP BY 1), r AS (SELECT label, t.word, (1 + ln(n)) * ln(1 + (SELECT count(DISTINCT label) FROM t) / df) AS w FROM t JOIN h ON h.word = t.word),
g AS (SELECT label, word, w / sqrt(sum(w * w) OVER (PARTITION BY label)) AS w FROM r), m AS (SELECT b.vec_id, g.label, sum(n * w) AS dot FROM b JOIN g ON g.word = b.word GROUP BY 1, 2), l AS (SELECT vec_id, any_value(label) AS label, sqrt(sum(n * n)) AS l FROM b GROUP BY 1),
z AS (SELECT m.vec_id, m.label, round(dot / l, 9) AS cosine FROM m JOIN l ON l.vec_id = m.vec_id), f AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) AS k FROM z)
SELECT l.vec_id, l.vec_id % 5 = 0 AS held_out, l.label, f.label AS predicted, round(coalesce(cosine, 0), 6) AS cosine FROM l LEFT JOIN f ON f.vec_id = l.vec_id AND k = 1""")
def class_by_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the classes learned from four fifths of the rows; every row classified, the fifth apart marked."""
    bagged = written(words.bags(spelled(spark, d), "vec_id", "label"), "bags")
    held = F.col("vec_id") % 5 == 0
    found = words.classify(bagged, "vec_id", words.class_words(bagged.where(~held), "label"), "label")
    own = table(spark, d, "embeddings").select("vec_id", "label")
    return rounded(found.join(own, "vec_id").select("vec_id", held.alias("held_out"), "label", "predicted", "cosine"))


@query(f"""
WITH {_BAGS}, o AS (SELECT vec_id, sum(n * n) AS own FROM b WHERE vec_id % 50 = 0 GROUP BY 1), m AS (SELECT q.vec_id AS query_id, b.vec_id, sum(b.n * b.n - 2 * q.n * b.n) AS d FROM b q JOIN b ON q.word = b.word AND q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, m.vec_id, CAST(own + d AS BIGINT) AS distance FROM m JOIN o ON o.vec_id = m.query_id)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r QUALIFY rank <= 5""")
def nearest_by_words(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest bags of every row whose id is divisible by 50, among all rows."""
    bagged = written(words.bags(spelled(spark, d), "vec_id"), "bags")
    return words.nearest_bags(bagged.where("vec_id % 50 = 0"), bagged, "vec_id", 5)
