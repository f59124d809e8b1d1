"""Attention maps of slices and volumes: weighted Gaussian densities on the voxel grid of every viewed slice.

All slices of all sessions are one plan. Samples of a slice are numbered and dealt in blocks for fixations; each task
turns its batches into partial matrices (two thin kernel matrices multiplied), which are summed by grid row. No sample
meets a grid cell as a row, so the shuffle grows with the slices' grids and not with samples times cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oculith.operators.geometry import AXES, slice_number
from oculith.operators.kinematics import attention_weights, fixations_norm
from oculith.operators.ordered import dense, quantiles
from oculith.sources.stored import stored

SLICE = ("session_id", "plane", "slice_num")


def plane_size(dims: tuple[int, int, int], which: int, plane: str = "plane") -> Column:
    """Size of the volume along the screen's x (0), the screen's y (1) or across the slices (2) of a row's plane."""
    out = F.when(F.lit(False), F.lit(0))
    for name, axes in AXES.items():
        out = out.when(F.col(plane) == name, F.lit(dims[axes[which]]))
    return out


def slice_hits(integrated: DataFrame, dims: tuple[int, int, int], tolerance: float = 0.02) -> DataFrame:
    """Each sample once for every slice number whose index lies within the tolerance; a sample may hit several or none.
    The candidates come from the sample itself, so nothing is joined."""
    last = plane_size(dims, 2) - 1
    low = F.greatest(F.ceil((F.col("slice_index") - tolerance) * last), F.lit(0))
    high = F.least(F.floor((F.col("slice_index") + tolerance) * last), last.cast("long"))
    hits = integrated.withColumn("at", F.explode(F.when(low <= high, F.sequence(low, high))))
    near = F.abs(F.col("slice_index") - F.col("at") / F.nullif(last, F.lit(0))) < tolerance
    return hits.filter(near | (last == 0)).withColumn("slice_num", (F.col("at") + 1).cast("int")).drop("at")


def viewed_slices(integrated: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """session_id, plane, slice_num of the slices that were opened while someone looked."""
    return integrated.select("session_id", "plane", slice_number("slice_index", "plane", dims).alias("slice_num")).distinct()


def grid_density(samples: DataFrame, keys: tuple[str, ...], frame: tuple[str, ...] = ("x", "y", "weight", "hx", "hy", "nx", "ny", "x0", "x1", "y0", "y1")) -> DataFrame:
    """keys, gx, gy, density: a weighted Gaussian density on a grid of nx by ny points from (x0, y0) to (x1, y1).

    `frame` names the columns with position, weight, bandwidths, grid size and limits; all but position and weight are
    the same throughout a key. Samples with a null position, or a weight that isn't positive, take no part.
    """
    x, y, w, hx, hy, nx, ny, x0, x1, y0, y1 = frame
    names = list(keys)
    used = samples.select(*keys, *frame).filter((F.col(w) > 0) & F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(hx) > 0) & (F.col(hy) > 0))
    schema = T.StructType([used.schema[k] for k in keys] + [T.StructField("gx", T.IntegerType()), T.StructField("row", T.ArrayType(T.DoubleType())), T.StructField("part", T.DoubleType())])

    def kernel(points: np.ndarray, low: float, high: float, n: int, h: float) -> np.ndarray:
        grid = np.linspace(low, high, n)
        return np.exp(-0.5 * ((points[:, None] - grid[None, :]) / h) ** 2) / (h * np.sqrt(2 * np.pi))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, g in batch.groupby(names, sort=False, dropna=False):
                one, weight = g.iloc[0], g[w].to_numpy(float)
                across = kernel(g[x].to_numpy(float), one[x0], one[x1], int(one[nx]), one[hx])
                down = kernel(g[y].to_numpy(float), one[y0], one[y1], int(one[ny]), one[hy])
                cells = across.T @ (down * weight[:, None])
                out = pd.DataFrame({"gx": np.arange(len(cells), dtype="int32"), "row": list(cells), "part": weight.sum()})
                for at, (name, value) in enumerate(zip(names, key)):
                    out.insert(at, name, value)
                yield out

    parts = used.mapInPandas(partial, schema)
    cells = parts.select(*keys, "gx", "part", F.posexplode("row").alias("gy", "value"))
    return cells.groupBy(*keys, "gx", "gy").agg((F.sum("value") / F.sum("part")).alias("density"))


def density(samples: DataFrame, keys: tuple[str, ...], n: int, bandwidth: float, weight: str | None = None) -> DataFrame:
    """keys, gx, gy, density of gaze_x, gaze_y on an n x n grid over the unit square, with one bandwidth."""
    one = {"__w": F.col(weight) if weight else F.lit(1.0), "hx": F.lit(bandwidth), "hy": F.lit(bandwidth), "nx": F.lit(n), "ny": F.lit(n), "x0": F.lit(0.0), "x1": F.lit(1.0), "y0": F.lit(0.0), "y1": F.lit(1.0)}
    return grid_density(samples.withColumns(one), keys, ("gaze_x", "gaze_y", *one))


def weighted_slices(integrated: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """In-bounds samples of every viewed slice with voxel position, fixation flag and attention weight; fixations and
    weights are worked out among the samples of one slice."""
    seen = slice_hits(integrated.filter("within_bounds"), dims).join(viewed_slices(integrated, dims), list(SLICE), "left_semi")
    # Fixations read their rows twice, and so do the weights: both are stored, so that plans don't double.
    seen = stored(dense(seen, keys=SLICE, name="at"), "slice-samples")
    df = attention_weights(stored(fixations_norm(seen, keys=SLICE, row="at"), "slice-fixations"), keys=SLICE).drop("at")
    nx, ny = plane_size(dims, 0), plane_size(dims, 1)
    return df.withColumns({"nx": nx, "ny": ny, "x": F.col("gaze_x") * (nx - 1), "y": F.col("gaze_y") * (ny - 1)})


def slice_heatmaps(integrated: DataFrame, dims: tuple[int, int, int], bandwidth: float = 5.0, normalise: bool = True) -> DataFrame:
    """session_id, plane, slice_num, gx, gy, attention of each viewed slice; normalised by the slice's largest cell."""
    df = weighted_slices(integrated, dims).withColumns({"hx": F.lit(bandwidth), "hy": F.lit(bandwidth), "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.col("nx") - 1.0, "y1": F.col("ny") - 1.0})
    cells = grid_density(df.withColumnRenamed("attention_weight", "weight"), SLICE).withColumnRenamed("density", "attention")
    return normalised(cells, SLICE) if normalise else cells


def volume_heatmap(integrated: DataFrame, dims: tuple[int, int, int], bandwidth: float = 5.0) -> DataFrame:
    """voxel_i, voxel_j, voxel_k (from 0) and attention per session and plane, normalised by the largest voxel."""
    cells = normalised(slice_heatmaps(integrated, dims, bandwidth, False), ("session_id", "plane"))
    axis = [F.when(F.lit(False), F.lit(0)) for _ in range(3)]
    for name, axes in AXES.items():
        for source, to in zip((F.col("gx"), F.col("gy"), F.col("slice_num") - 1), axes):
            axis[to] = axis[to].when(F.col("plane") == name, source)
    return cells.select("session_id", "plane", *[a.cast("int").alias(f"voxel_{n}") for a, n in zip(axis, "ijk")], "attention")


def normalised(cells: DataFrame, keys: tuple[str, ...], value: str = "attention") -> DataFrame:
    """The value divided by its largest of each key, where that is positive."""
    top = cells.groupBy(*keys).agg(F.max(value).alias("top"))
    return cells.join(top, list(keys)).withColumn(value, F.when(F.col("top") > 0, F.col(value) / F.col("top")).otherwise(F.col(value))).drop("top")


def overlay(cells: DataFrame, keys: tuple[str, ...] = SLICE, value: str = "attention", share: float = 0.05) -> DataFrame:
    """The value, null where below a share of its key's largest."""
    top = cells.groupBy(*keys).agg(F.max(value).alias("top"))
    return cells.join(top, list(keys)).withColumn(value, F.when(F.col(value) >= share * F.col("top"), F.col(value))).drop("top")


def reference_bandwidth(samples: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """keys, hx, hy: kernel widths by the normal reference rule, from the smaller of deviation and quartile range."""
    out = samples.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"))
    for c, name in ((x, "qx"), (y, "qy")):
        out = out.join(quantiles(samples, c, (0.25, 0.75), keys, name), list(keys))
    width = lambda s, q: 1.06 * F.least(F.col(s), (F.col(q)[1] - F.col(q)[0]) / 1.34) * F.pow("n", F.lit(-0.2))
    return out.select(*keys, width("sx", "qx").alias("hx"), width("sy", "qy").alias("hy"))


def attention_export(volume: DataFrame, threshold: float = 0.01) -> DataFrame:
    """Voxels above the threshold, most attended first."""
    return volume.filter(F.col("attention") > threshold).orderBy(F.desc("attention"), "voxel_i", "voxel_j", "voxel_k")
