"""Exact deduplication as a stateful stream, with DataFrame functions only.

Rows enter as (digest, doc_id, locator): SHA-256 of the whole text and the file
and row that hold it. A stream groups them by digest; its keyed state, on disk in
RocksDB and without expiry, keeps for each digest the stable row (the largest
doc_id, then locator) and the number of rows. Partial sums go into the shuffle, so
a text that a third of all rows share is a handful of state updates.

Every hit is then checked on full bytes: the stable row's text is read by its
locator and compared with each other row of its digest, in a join that Spark
splits where one digest is hot. Rows that share a digest but not the bytes make
groups of their own.

The stream's checkpoint (offsets and state) is in the shared folder and each micro-
batch overwrites its own output. With a ``folder`` of the caller's, intake, state
and output stay there: a run that broke off is resumed by the same call, from the
micro-batch it had reached, with the same result.

Nulls and odd cases: null counts as empty text; a null doc_id is smaller than any
id; of rows that repeat id and text one stays (the last by locator). Empty input,
empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, Scratch

#: Intake files of one micro-batch.
FILES_PER_BATCH = 1000
#: State on disk; many small stores would each set 4 MB aside for their manifest, and each have buffers of its own.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}


def located(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``documents`` with file and row of each row; written first if they do not come from files."""
    try:
        return documents.withColumns({"wl_file": F.col("_metadata.file_path"), "wl_row": F.col("_metadata.row_index")})
    except AnalysisException:
        return scratch.keep(documents, "rows").withColumns({"wl_file": F.col("_metadata.file_path"), "wl_row": F.col("_metadata.row_index")})


def stream_groups(intake_path: str, schema, scratch: Scratch, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """digest, n and keep (doc_id, wl_file, wl_row) of every digest, out of the stream's state."""
    spark = scratch.spark
    old = {key: spark.conf.get(key, None) for key in STORE}
    for key, value in STORE.items():
        spark.conf.set(key, value)
    out = scratch.path("updates")
    try:
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(intake_path)
        state = source.groupBy("digest").agg(F.max(F.struct("doc_id", "wl_file", "wl_row")).alias("keep"), F.count("*").alias("n"))

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        put(spark.createDataFrame([], state.schema), -1)  # a stream without rows has no batch
        state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", scratch.path("stream")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    updates = spark.read.schema(state.schema).parquet(out)
    last = updates.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("x"))  # a digest's count only grows
    return scratch.keep(last.select("digest", "x.n", "x.keep"), "groups")


def exact_duplicates(documents: DataFrame, name: str = "dedup", files_per_batch: int = FILES_PER_BATCH, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, located documents). Rows: doc_id, wl_file, wl_row, digest, keep (doc_id, wl_file, wl_row), group_size, kept."""
    spark = documents.sparkSession
    scratch = Scratch(spark, name, folder)
    docs = located(documents, scratch)
    body = F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest")
    intake = scratch.keep(docs.select(digest, "doc_id", "wl_file", "wl_row"), "intake")
    groups = stream_groups(scratch.path("intake"), intake.schema, scratch, files_per_batch)
    scratch.drop("stream", "updates")
    hits = groups.where("n > 1").select("digest", "keep")
    slot = F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).alias("wl_slot")
    # few rows are in groups: the others stop at a broadcast of SLOTS numbers at most
    some = docs.select(digest, body.alias("body"), "doc_id", "wl_file", "wl_row").withColumn("wl_slot", slot).join(F.broadcast(hits.select(slot).distinct()), "wl_slot", "left_semi").drop("wl_slot")
    here = (F.col("wl_file") == F.col("keep.wl_file")) & (F.col("wl_row") == F.col("keep.wl_row"))
    first = some.join(hits, "digest").where(here).select("digest", F.col("body").alias("first_body"))
    unlike = some.join(first, "digest").where("body <> first_body").select("digest", "body", "doc_id", "wl_file", "wl_row")
    unlike = scratch.keep(unlike, "unlike")
    rows = intake.join(groups.select("digest", "keep", "n"), "digest")
    if unlike.limit(1).count():  # one digest, other bytes
        own = unlike.groupBy("digest", "body").agg(F.max(F.struct("doc_id", "wl_file", "wl_row")).alias("own"), F.count("*").alias("own_n"))
        own = unlike.join(own, ["digest", "body"]).select("wl_file", "wl_row", "own", "own_n")
        gone = unlike.groupBy("digest").agg(F.count("*").alias("gone"))
        rows = rows.join(own, ["wl_file", "wl_row"], "left").join(gone, "digest", "left").select(
            "doc_id", "wl_file", "wl_row", "digest", F.coalesce("own", "keep").alias("keep"), F.coalesce("own_n", F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")
        )
    return rows.select("doc_id", "wl_file", "wl_row", "digest", "keep", F.col("n").alias("group_size"), here.alias("kept")), docs
