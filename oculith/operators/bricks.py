"""Voxels packed in bricks: a row for each block of 16 x 16 x 16 voxels, so that no join or shuffle has a row a voxel.

Bricks are numbered along a Morton curve (the bits of their three places, interleaved): neighbours in space are mostly
neighbours in number, and a table dealt by ranges of it keeps them in few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oculith.functions.columns import col, rows

#: Voxels along a brick's edge, and bits of a brick's place that the number holds.
EDGE, BITS = 16, 20


def morton(*places: Column) -> Column:
    """The number of a brick from its three places (each below 2^BITS, not negative)."""
    bit = lambda at, b, axis: F.shiftleft(F.shiftright(at.cast("long"), b).bitwiseAND(1), 3 * b + axis)
    parts = [bit(at, b, axis) for axis, at in enumerate(places) for b in range(BITS)]
    while len(parts) > 1:  # a tree of sums, as a chain of sixty would be deep
        parts = [a.bitwiseOR(b) for a, b in zip(parts[::2], parts[1::2])] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def brick_of(*ijk: Column | str) -> Column:
    return morton(*[F.floor(col(c) / F.lit(EDGE)) for c in ijk])


def packed(voxels: DataFrame, values: tuple[str, ...], keys: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """keys, brick, width, height, and an array for each of the values, from voxels with i, j, k (from 0).

    Arrays run along i, then j, then k, over the part of the brick that its volume fills. Where voxels are missing, `places`
    has the place of each that is there; it is null for full bricks. A voxel given twice counts as the smaller value. Rows
    with a null place are left out.
    """
    known = voxels.dropna(subset=["i", "j", "k"])
    inside = {c: (F.col(c) % EDGE).cast("int") for c in "ijk"}
    place = inside["i"] + EDGE * (inside["j"] + EDGE * inside["k"])
    known = known.groupBy(*keys, brick_of("i", "j", "k").alias("brick"), place.alias("place")).agg(F.min(F.struct(*values)).alias("v"))
    cells = F.array_sort(F.collect_list(F.struct("place", "v")))  # EDGE^3 at most
    out = known.groupBy(*keys, "brick").agg(cells.alias("cells"), rows().alias("n"), *[F.max(at).alias(name) for name, at in (("w", F.col("place") % EDGE), ("h", F.floor(F.col("place") / EDGE) % EDGE), ("d", F.floor(F.col("place") / (EDGE * EDGE))))])
    full = F.col("n") == (F.col("w") + 1) * (F.col("h") + 1) * (F.col("d") + 1)
    of = lambda v: F.transform("cells", lambda c: c["v"][v])
    return out.select(
        *keys, "brick", (F.col("w") + 1).cast("int").alias("width"), (F.col("h") + 1).cast("int").alias("height"),
        F.when(~full, F.transform("cells", lambda c: c["place"])).alias("places"), *[of(v).alias(v) for v in values],
    )


def picked(samples: DataFrame, bricks: DataFrame, values: tuple[str, ...], ijk: tuple[str, str, str] = ("voxel_i", "voxel_j", "voxel_k"), keys: tuple[str, ...] = ("volume_id",)) -> DataFrame:
    """Samples with the values of their voxels; null where the volume has none.

    The join is by brick: both sides are dealt by (keys, brick), one side a row a brick. A brick that many look at is split
    by adaptive execution as any skewed key.
    """
    i, j, k = (F.col(c) for c in ijk)
    placed = samples.withColumn("__brick", F.when((i >= 0) & (j >= 0) & (k >= 0), brick_of(i, j, k)))
    side = bricks.select(*keys, F.col("brick").alias("__brick"), *[F.col(c).alias(f"__{c}") for c in ("width", "height", "places", *values)])
    x, y, z = ((c % EDGE).cast("int") for c in (i, j, k))
    at = x + F.col("__width") * (y + F.col("__height") * z) + 1
    within = (x < F.col("__width")) & (y < F.col("__height"))
    some = F.array_position("__places", x + EDGE * (y + EDGE * z)).cast("int")
    found = F.when(F.col("__places").isNull(), F.when(within, at)).when(some > 0, some)
    both = placed.join(side, [*keys, "__brick"], "left").withColumn("__at", found)
    return both.withColumns({v: F.when(F.col("__at") <= F.size(f"__{v}"), F.get(f"__{v}", F.col("__at") - 1)) for v in values}).drop("__brick", "__at", *[f"__{c}" for c in ("width", "height", "places", *values)])
