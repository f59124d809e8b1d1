"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oculith.plans import alignment, coordinates, files, geometry, live, motion, sketches, studies, volumes

GROUPS = (alignment.QUERIES, motion.QUERIES, geometry.QUERIES, studies.QUERIES, coordinates.QUERIES, files.QUERIES, volumes.QUERIES, live.QUERIES, sketches.QUERIES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for group in GROUPS for name, (f, _) in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, (_, sql) in group.items() if sql}
