"""The registered queries and the pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from chronolake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_whole_table(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    table, key = {"op1": ("embeddings", None), "op2": ("pages", "page_id"), "op6": ("conversations", "conv_id"), "op13": ("benchmark", "item_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    whole = spark.read.parquet(f"{SF}/{table}.parquet")
    if key:
        want = {r[0] for r in whole.select(key).distinct().collect()} | ({-1} if name.startswith("op6") else set())
        assert {r[key] for r in rows} == want
        assert name.startswith(("op10", "op13")) or len(rows) == len(want)
    else:
        assert len(rows) == 5 * whole.where("vec_id % 50 = 0").count()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(str(tuple(r[k] for k in cols)) for r in df.collect()) == sorted(str(tuple(r[names.index(k)] for k in cols)) for r in rel.fetchall())


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= before, name
        before = now
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good, junk = set(labels[labels.quality == 1].doc_id), set(labels[labels.quality == 0].doc_id)
    assert not before & junk and len(before & good) >= 0.8 * len(good)
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == before


def test_pipeline_stages_take_odd_documents(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "no id", "en", "s", 5), (3, "call +1 (555) 010-9999 now", "en", "s", 26), (3, "call +1 (555) 010-9999 now", "en", "s", 26)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, odd.where("false")):
            stage(spark, docs, SF).collect()
    redacted = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.private(spark, odd, SF).collect()}
    assert redacted[3] == ("call [PHONE] now", 16) and redacted[1] == (None, None)
