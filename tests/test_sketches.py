"""Sketches against exact ranks: single ones, merged ones, and awkward columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from oculith.operators import sketches


def off(values: np.ndarray, answer: float, p: float) -> float:
    """How far, as a share of the values, the answer's rank is from p; 0 anywhere within a tie."""
    low, high = (values < answer).mean(), (values <= answer).mean()
    return max(0.0, low - p, p - high)


@pytest.mark.parametrize("k", [64, 512])
def test_rank_error_of_merged_sketches(spark, k):
    """Skewed, tied and sorted values over 90 cells of unequal size: each session and all of them keep the bound."""
    at, levels = F.col("id"), (0.01, 0.25, 0.5, 0.9, 0.99)
    value = F.when(at % 3 == 0, F.exp(F.randn(7))).when(at % 3 == 1, at / 1000.0).otherwise(F.floor(F.rand(5) * 9).cast("double"))
    df = spark.range(240_000).select((at % 3).alias("session_id"), F.sqrt(at.cast("double") * 30).alias("time_sec"), value.alias("v")).cache()
    parts = sketches.sketches(df, "v", k=k)
    assert parts.count() > 250
    values = df.toPandas()
    names = [f"p{p * 100:g}" for p in levels]
    for row in sketches.summary(parts, levels, ("session_id",)).collect():
        own = values.v[values.session_id == row["session_id"]].to_numpy()
        assert row["n"] == len(own) and row["low"] == own.min() and row["high"] == own.max()
        assert all(off(own, row[name], p) <= 1.5 * sketches.rank_error(k) for name, p in zip(names, levels))
    (whole,) = sketches.summary(sketches.merged(parts, ("session_id",)), levels).collect()
    assert whole["n"] == 240_000 and all(off(values.v.to_numpy(), whole[name], p) <= 1.5 * sketches.rank_error(k) for name, p in zip(names, levels))
    df.unpersist()


def test_few_values_are_exact_and_faulty_ones_left_out(spark):
    rows = [(1, 0.0, float(x)) for x in (5, 1, 3, 3, 9)] + [(1, None, 7.0), (1, 1.0, None), (1, 2.0, float("nan")), (2, 0.0, None), (3, 0.0, float("inf"))]
    parts = sketches.sketches(spark.createDataFrame(rows, "session_id long, time_sec double, v double"), "v")
    got = {r["session_id"]: r for r in sketches.summary(parts, (0.0, 0.5, 1.0), ("session_id",)).collect()}
    assert sorted(got) == [1, 3] and got[3]["p50"] == float("inf")
    assert [got[1][c] for c in ("n", "low", "p0", "p50", "p100", "high")] == [6, 1.0, 1.0, 3.0, 9.0, 9.0]
    assert sketches.merged(parts).select(sketches.share_upto(F.lit(5.0))).first()[0] == pytest.approx(4 / 7)
    empty = sketches.sketches(spark.createDataFrame([], "session_id long, time_sec double, v double"), "v")
    assert empty.count() == 0 and sketches.summary(empty).count() == 0


def test_partial_sketches_are_made_before_the_exchange(spark):
    df = spark.range(100).select(F.lit(1).alias("session_id"), F.col("id").cast("double").alias("time_sec"), F.rand().alias("v"))
    plan = sketches.sketches(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_kll_sketch_agg_double") > plan.index("Exchange hashpartitioning")  # printed from the result down
