"""Registered queries: name -> callable(spark, sf_dir), and DuckDB SQL by the same names."""

from __future__ import annotations

from . import job_queries, media_queries, sequence_queries, signal_queries, text_queries, timeline_queries  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
