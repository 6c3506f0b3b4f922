"""Jobs and their surroundings as columns: identities, progress, resuming, device lists, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRUNCATED_MS = 3000


def job_id(name: Column, size: Column, model: Column) -> Column:
    """One id for the same file and model."""
    return F.sha1(F.concat_ws("\n", name, size.cast("string"), model))


def content_key(config: Column, payload: Column) -> Column:
    """Key of a cached result: settings and the bytes they were used on."""
    return F.sha2(F.concat(F.encode(config, "UTF-8"), F.unhex(F.lit("00")), payload), 256)


def fraction(done: Column, total: Column) -> Column:
    """Share done, in 0..1; null while the total is unknown."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total)))


def real_time_factor(audio_ms: Column, wall_ms: Column) -> Column:
    return F.when(wall_ms > 0, audio_ms / wall_ms)


def remaining_ms(done: Column, total: Column, wall_ms: Column) -> Column:
    """Time still to go at the rate so far; null before anything is done."""
    return F.when((done > 0) & (total > 0), F.round(wall_ms * (total - done) / done).cast("long"))


def is_truncated(decoded_end: Column, duration: Column) -> Column:
    return decoded_end < duration - TRUNCATED_MS


def may_resume(version: Column, paths: Column, model: Column, want_version: Column, want_paths: Column, want_model: Column, truncated: Column) -> Column:
    """A state is taken up only for the same version, paths and model, and if no decoding was cut short."""
    return version.eqNullSafe(want_version) & paths.eqNullSafe(want_paths) & model.eqNullSafe(want_model) & ~F.coalesce(truncated, F.lit(False))


def devices(lines: DataFrame, line: str = "value") -> DataFrame:
    """(index, name, memory_mb, capability) of ``index, name, memory [MiB], capability`` lines; others are skipped."""
    shape = r"^\s*(\d+)\s*,\s*(.*?)\s*,\s*(\d+)(?:\s*MiB)?\s*,\s*(\d+(?:\.\d+)?)\s*$"
    part = lambda k: F.regexp_extract(line, shape, k)
    return lines.where(F.col(line).rlike(shape)).select(part(1).cast("int").alias("index"), part(2).alias("name"), part(3).cast("long").alias("memory_mb"), part(4).cast("double").alias("capability"))


def best_device(found: DataFrame, least_memory_mb: int, least_capability: float) -> DataFrame:
    """The eligible device with most memory, the lowest index of equals: one row or none."""
    ok = found.where((F.col("memory_mb") >= least_memory_mb) & (F.col("capability") >= least_capability))
    return ok.agg(F.max(F.struct("memory_mb", (-F.col("index")).alias("order"), "index", "name", "capability")).alias("d")).where("d is not null").select("d.index", "d.name", "d.memory_mb", "d.capability")


def packs_to_json(packs: DataFrame, columns: dict[str, object]) -> Column:
    """A pack as JSON without the fields that have their default."""
    return F.to_json(F.struct(*(F.when(~F.col(c).eqNullSafe(F.lit(d)), F.col(c)).alias(c) if d is not None else F.col(c) for c, d in columns.items())))


def packs_by_language(packs: DataFrame, language: str, profile: str) -> DataFrame:
    """The first pack, by place, of each language that has the profile."""
    one = packs.where(F.col("profile") == profile).select("place", "id", F.explode("languages").alias("language")).where(F.col("language") == language)
    return one.withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("place"))).where("k = 1").select("language", "id")
