"""Latency between two clocks by cross-correlation of regular signals, and curves of scores against labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oculith.functions.columns import rows

#: Positions of a signal that one group holds, beside a halo of the largest lag.
POSITIONS = 16_384
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def cross_correlation(signal: DataFrame, max_lag: int, x: str = "gaze", y: str = "event", idx: str = "idx", keys: tuple[str, ...] = ("session_id",), size: int = POSITIONS) -> DataFrame:
    """keys, lag, n, r: correlation of x at i with y at i + lag, for every lag up to max_lag both ways.

    Blocks of positions are dealt with a halo of y beside them; each gives six sums a lag, so no position meets a lag as
    a row, and a long signal spreads over tasks. Positions may be missing; r is null where a side is constant.
    """
    block = F.floor(F.col(idx) / F.lit(size)).cast("long")
    near = F.array_distinct(F.array(block, F.floor((F.col(idx) - max_lag) / F.lit(size)).cast("long"), F.floor((F.col(idx) + max_lag) / F.lit(size)).cast("long")))
    if max_lag > size:
        raise ValueError(f"the largest lag is over {size} positions")
    dealt = signal.select(*keys, F.col(idx).cast("long").alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.explode(near).alias("block"))
    # Sums are of deviations from a common level of each key, so that they don't cancel.
    level = signal.groupBy(*keys).agg(F.avg(x).alias("level_x"), F.avg(y).alias("level_y"))
    dealt = dealt.join(level, list(keys))
    fields = [signal.schema[k] for k in keys] + [T.StructField("lag", T.IntegerType())] + [T.StructField(s, T.DoubleType()) for s in SUMS]

    def sums(key: tuple, rows_: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * size
        a, b = np.full(size, np.nan), np.full(size + 2 * max_lag, np.nan)
        at, inside = rows_["i"].to_numpy() - first, rows_["block"].to_numpy() * size == rows_["i"].to_numpy() // size * size
        a[at[inside]] = (rows_["x"] - rows_["level_x"]).to_numpy()[inside]
        b[at + max_lag] = (rows_["y"] - rows_["level_y"]).to_numpy()
        found = lag_sums(a, b, max_lag)
        for k, (name, value) in enumerate(zip(keys, key)):
            found.insert(k, name, value)
        return found

    return correlated(dealt.groupBy(*keys, "block").applyInPandas(sums, T.StructType(fields)), keys)


def lag_sums(a: np.ndarray, b: np.ndarray, max_lag: int) -> pd.DataFrame:
    """lag and SUMS of a block of x against its y, which reaches `max_lag` positions further on both sides; NaN is missing."""
    out = []
    for lag in range(-max_lag, max_lag + 1):
        other = b[max_lag + lag : max_lag + lag + len(a)]
        ok = ~(np.isnan(a) | np.isnan(other))
        u, v = a[ok], other[ok]
        out.append((lag, len(u), u.sum(), v.sum(), u @ u, v @ v, u @ v))
    return pd.DataFrame(out, columns=["lag", *SUMS]).astype({"lag": "int32", "n": float})


def correlated(parts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, lag, n, r from the blocks' sums; r is null where a side is constant."""
    total = parts.groupBy(*keys, "lag").agg(*[F.sum(s).alias(s) for s in SUMS]).filter("n > 0")
    n = F.col("n")
    vx, vy, co = (F.col(a) - F.col(b) * F.col(c) / n for a, b, c in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    r = F.when((vx > 1e-12 * n) & (vy > 1e-12 * n), co / F.sqrt(vx * vy))
    return total.select(*keys, "lag", n.cast("long").alias("n"), r.alias("r"))


def latency(signal: DataFrame, max_lag: int, hertz: float, keys: tuple[str, ...] = ("session_id",), **names: str) -> DataFrame:
    """One row per key: best lag (largest |r|, the smallest lag on ties, sign flipped), latency in ms, prominence against
    the median of the other lags, peak, and its sigma."""
    return peaks(cross_correlation(signal, max_lag, keys=keys, **names), hertz, keys)


def peaks(correlations: DataFrame, hertz: float, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """latency() from keys, lag, n, r."""
    cc = correlations.withColumn("a", F.abs("r")).filter("a is not null")
    best = F.max_by(F.struct("lag", "a", "n"), F.struct(F.round("a", 12), -F.col("lag"))).alias("b")
    every = F.sort_array(F.collect_list(F.struct("a", "lag"))).alias("every")  # 2 * max_lag + 1 values at most
    rest = F.transform(F.filter("every", lambda e: e["lag"] != F.col("b.lag")), lambda e: e["a"])
    half = (F.size("rest") - 1) / 2.0
    median = F.when(F.size("rest") > 0, (F.get("rest", F.floor(half).cast("int")) + F.get("rest", F.ceil(half).cast("int"))) / 2.0)
    ms = 1000.0 / hertz
    found = cc.groupBy(*keys).agg(best, every).withColumn("rest", rest)
    return found.select(*keys, (-F.col("b.lag")).alias("lag"), (-F.col("b.lag") * ms).alias("latency_ms"), F.col("b.a").alias("peak"), F.try_divide(F.col("b.a"), median).alias("prominence"), (ms / (F.sqrt(F.col("b.n").cast("double")) * F.col("b.a"))).alias("sigma_ms"))


def roc_points(scores: DataFrame, score: str, label: str, keys: tuple[str, ...] = (), cells: int = 256) -> DataFrame:
    """keys, threshold, tp, fp, n_pos, n_neg, tpr, fpr: the curve, a point for each different score (all rows at or over
    it are positive). Labels are 0 or 1.

    Scores are counted first; cells between approximate quantiles of the different scores are then summed, so that no
    task needs all scores of a key.
    """
    own = keys or ("one",)
    base = scores if keys else scores.withColumn("one", F.lit(0))
    points = base.groupBy(*own, F.col(score).cast("double").alias("s")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    cuts = points.groupBy(*own).agg(F.array_sort(F.array_distinct(F.percentile_approx("s", F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(8 * cells)))).alias("cuts"))
    placed = points.join(cuts, list(own)).withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("s")))).drop("cuts")
    above = Window.partitionBy(*own).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*own)
    sums = placed.groupBy(*own, "cell").agg(F.sum("p").alias("cp"), F.sum("q").alias("cq"))
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    sums = sums.select(*own, "cell", before("cp").alias("bp"), before("cq").alias("bq"), F.sum("cp").over(whole).alias("n_pos"), F.sum("cq").over(whole).alias("n_neg"))
    inside = Window.partitionBy(*own, "cell").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(sums, [*own, "cell"]).withColumns({"tp": F.col("bp") + F.sum("p").over(inside), "fp": F.col("bq") + F.sum("q").over(inside)})
    return out.select(*keys, F.col("s").alias("threshold"), "p", "q", "tp", "fp", "n_pos", "n_neg", F.try_divide("tp", "n_pos").alias("tpr"), F.try_divide("fp", "n_neg").alias("fpr"))


def roc(scores: DataFrame, score: str, label: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: AUC and the threshold with the largest difference of true and false positive rates (the smallest
    score on ties). Ties of score are one point."""
    points = roc_points(scores, score, label, keys)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0))
    best = F.max_by("threshold", F.struct(F.round(F.col("tpr") - F.col("fpr"), 12), -F.col("threshold")))
    out = points.groupBy(*keys).agg(F.try_divide(area, F.first("n_pos") * F.first("n_neg")).alias("auc"), best.alias("threshold"), F.max(F.round(F.col("tpr") - F.col("fpr"), 12)).alias("youden"))
    return out.filter("auc is not null")


def confusion(df: DataFrame, actual: Column, predicted: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: counts of the four outcomes, accuracy, sensitivity, specificity (null where there is none to count)."""
    a, p = actual.cast("boolean"), predicted.cast("boolean")
    out = df.groupBy(*keys).agg(F.count_if(a & p).alias("tp"), F.count_if(~a & p).alias("fp"), F.count_if(a & ~p).alias("fn"), F.count_if(~a & ~p).alias("tn"), rows().alias("n"))
    share = lambda x, y: F.try_divide(x.cast("double"), y.cast("double"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": share(tp + tn, tp + fp + fn + tn), "sensitivity": share(tp, tp + fn), "specificity": share(tn, tn + fp)})

