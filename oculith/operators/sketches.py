"""Quantiles by mergeable sketches, for tables where exact ranks aren't needed.

A sketch (KLL) is a small binary column: one a session and cell of time, made in one pass with partial sketches on the map
side. Sketches merge over cells, sessions and days, so stored ones answer later questions without the samples. Ranks are
off by `rank_error(k)` at most in about 99 % of the answers; up to k values a sketch holds them all and is exact. The
exact form stays `ordered.quantiles`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oculith.operators.ordered import SECONDS, SESSION, cell_of

#: Size of a sketch: about k values in the lowest level, 8 bytes each, and a logarithm's more above.
K = 4096


def rank_error(k: int = K) -> float:
    """How far the rank of one quantile may be off, as a share of all values (the sketch's published bound, 99 %)."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, value: str | Column, keys: tuple[str, ...] = SESSION, cell: Column | None = None, k: int = K) -> DataFrame:
    """keys, cell, n, low, high, sketch of the values that are numbers; null and NaN are left out, infinite ones count.

    `cell` (by default the time cell of time_sec) is null where there is none. An empty table gives no rows; a group
    without values has none either.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    own = df.select(*keys, (cell_of("time_sec", SECONDS) if cell is None else cell).alias("cell"), v.alias("v")).filter("v is not null and not isnan(v)")
    return own.groupBy(*keys, "cell").agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch"))


def merged(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, low, high, sketch: sketches folded to coarser keys (none: one row, or none of an empty table)."""
    out = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return out.filter("n > 0")


def quantile_columns(probabilities: tuple[float, ...], sketch: str = "sketch") -> list[Column]:
    """p25, p50, ...: for each probability, the smallest value whose share of values at or below it reaches it."""
    return [F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))).alias(f"p{p * 100:g}".replace(".", "_")) for p in probabilities]


def share_upto(value: Column, sketch: str = "sketch") -> Column:
    """Share of the values at or below one."""
    return F.kll_sketch_get_rank_double(sketch, value.cast("double"))


def summary(parts: DataFrame, probabilities: tuple[float, ...] = (0.25, 0.5, 0.75), keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, low, the quantiles, high: a column's summary from stored sketches."""
    return merged(parts, keys).select(*keys, "n", "low", *quantile_columns(probabilities), "high")


def image_bounds(parts_x: DataFrame, parts_y: DataFrame, keys: tuple[str, ...] = SESSION, tail: float = 0.02) -> DataFrame:
    """keys, left, right, top, bottom: the rectangle between the tails of both coordinates' sketches."""
    ends = lambda parts, low, high: merged(parts, keys).select(*keys, *[c.alias(n) for c, n in zip(quantile_columns((tail, 1.0 - tail)), (low, high))])
    return ends(parts_x, "left", "right").join(ends(parts_y, "top", "bottom"), list(keys))
