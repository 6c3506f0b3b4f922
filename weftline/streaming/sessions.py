"""Structured Streaming forms: sessions, segments with state, idempotent frames, late rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.segment import Segmenter


def session_counts(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Gap sessions of a stream (or batch) by Spark's own session window; rows later than ``late`` are dropped, as the watermark says."""
    s = events.withWatermark(time, late) if events.isStreaming else events
    out = s.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    return out.drop("session_window")


def stream_segments(windows: DataFrame) -> DataFrame:
    """Speech segments of windows(file_id, window, prob, last): state is one open segment a file; ``last`` on the final window flushes it.

    Windows of a file must come in order; one before the place reached is a
    repeat and is dropped, one beyond it is an error.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = Segmenter.load(state.get) if state.exists else Segmenter()
        rows = pd.concat(list(batches)).sort_values("window")
        out, ended = [], False
        for w, p, last in zip(rows["window"], rows["prob"], rows["last"], strict=True):
            if w < s.at:
                continue
            if w > s.at:
                raise ValueError(f"file {key[0]}: window {w} came where {s.at} was due")
            out += s.feed(float(p))
            if last:
                out += s.flush()
                ended = True
        if ended:
            state.remove()
        else:
            state.update(s.dump())
        total = s.at * 32
        yield pd.DataFrame([(key[0], a, min(z, total) if ended else z, ra, rz) for a, z, ra, rz in out], columns=["file_id", "start_ms", "end_ms", "raw_start_ms", "raw_end_ms"])

    return windows.groupBy("file_id").applyInPandasWithState(
        run, "file_id long, start_ms long, end_ms long, raw_start_ms long, raw_end_ms long", "open_at long, silent_at long, probs array<double>, at long, padded_end long", "append", GroupStateTimeout.NoTimeout
    )


def low_watermark(pending: DataFrame, key: str, start: str) -> DataFrame:
    """Where a file may resume: the earliest start among what is not yet committed."""
    return pending.where("not committed").groupBy(key).agg(F.min(start).alias("resume_at"))


def run_available(stream: DataFrame, spark: SparkSession, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there, into files, and read them; a restart with the same folders goes on where it stopped."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upsert_frames(stream: DataFrame, spark: SparkSession, out: str, checkpoint: str, keys: list[str]) -> None:
    """Write frames by position: each micro-batch overwrites its own part, and a frame fed again replaces itself when read by ``latest_frames``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).withColumn("wl_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/part={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_frames(spark: SparkSession, out: str, keys: list[str], value: str) -> DataFrame:
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by(value, "wl_batch").alias(value))
