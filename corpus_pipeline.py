"""A training corpus out of ``documents``: five stages, each on what the one before kept.

Rows are named by file and row of the table a stage reads, never by doc_id, so
repeated and null ids are rows like others. Nulls and odd cases: a null text is an
empty one, which is scored by the classifier like any, and of empty texts exact
dedup leaves one; an empty table gives an empty result; columns of ``documents``
beyond those named in ``run`` are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decon, dedup, neardup, quality
from weftline.llm.common import Scratch, drop_rows
from weftline.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from this stage's own rows, accepts."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id."""
    scratch = Scratch(spark, "stage-copies")
    rows, placed = dedup.exact_duplicates(docs)
    gone = scratch.keep(rows.where("not kept").select("wl_file", "wl_row"), "gone")
    return drop_rows(placed, gone, ["wl_file", "wl_row"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one with the smallest doc_id, then the first by file and row."""
    placed = dedup.located(docs, Scratch(spark, "stage-near"))
    return drop_rows(placed, neardup.near_copies(placed, ("wl_file", "wl_row")), ["wl_file", "wl_row"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item matches."""
    scratch = Scratch(spark, "stage-leaks")
    placed = dedup.located(docs, scratch)
    found = decon.contaminated(placed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), row=("wl_file", "wl_row"))
    gone = scratch.keep(found.select("wl_file", "wl_row").distinct(), "gone")
    return drop_rows(placed, gone, ["wl_file", "wl_row"]).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, n_tokens, token_ids, and digests of the ids and of the text that they decode to."""
    return bpe.encode_documents(docs, tokenizer_path(), digests=True)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("bpe", encode)]

#: Learned scores and a tokenizer's merges are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), name).select(*docs.columns)
        if k:  # what the stage has read is no longer needed
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "n_tokens", F.xxhash64("token_ids").alias("ids_hash"), "token_ids", "decoded_sha256")
