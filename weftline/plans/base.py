"""Tables of a run as the timelines that queries work on, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``; where that is unset, a local master gets a temporary one and any other raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="weftline-")
    return f"{base.rstrip('/')}/weftline-{name}-{uuid.uuid4().hex[:12]}"


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues: file_id, idx, start_ms, end_ms, kind, value, label (a short text)."""
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file_id"), F.col("event_id").alias("idx"), start.alias("start_ms"), (start + 300 + (F.col("event_id") * 37) % 2700).alias("end_ms"),
        F.col("event_type").alias("kind"), "value", F.concat(F.col("event_type"), F.lit(" "), (F.col("event_id") % 50).cast("string")).alias("label"),
    )


#: The same in SQL, to put before a query.
CUES = """cues AS (SELECT user_id AS file_id, event_id AS idx, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 300 + (event_id * 37) % 2700 AS end_ms,
    event_type AS kind, value, event_type || ' ' || CAST(event_id % 50 AS VARCHAR) AS label FROM events)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query. SQL that begins with the word CUES may use that table; what follows may have its own WITH."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
            if sql.startswith("CUES"):
                body, head = sql[4:].strip(), "WITH"
                for own in ("WITH RECURSIVE", "WITH"):
                    if body.startswith(own):
                        head, body = own, ", " + body[len(own) :]
                        break
                ORACLES[name] = f"{head} {CUES} {body}"
        return f

    return put
