"""The queries of this subpackage, each an operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolake.llm import chat, langid, lexical, licenses, packing, pieces, pii, quality, rabitq, runs, simhash, toxicity, warc
from chronolake.llm.sql import ORACLE_SQL  # noqa: F401

PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the stated ones, rows whose id is divisible by 50; they search all rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rabitq.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(_documents(spark, sf_dir), public_tokenizers.path(PIECE_MODEL))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation -1 holds control strings in its texts."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(own)).withColumnRenamed("conv", "conv_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path(WORD_MODEL), with_ids=False)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.periodic_runs(runs.with_periods(_documents(spark, sf_dir))))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the stated ones, all benchmark items; they search all documents."""
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest": op1_nearest,
    "op2_warc": op2_warc,
    "op3_language": op3_language,
    "op4_pii": op4_pii,
    "op5_pieces": op5_pieces,
    "op6_chat": op6_chat,
    "op7_licenses": op7_licenses,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_toxicity": op11_toxicity,
    "op12_runs": op12_runs,
    "op13_search": op13_search,
}
