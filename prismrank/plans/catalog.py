"""Every registered query of the library with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismrank.plans import analysis, contexts, evaluation, provenance, ranking, wording

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (ranking, wording, contexts, analysis, provenance, evaluation):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
