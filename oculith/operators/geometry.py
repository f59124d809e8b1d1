"""Display, canvas, voxel, fractional and millimetre coordinates as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oculith.functions.columns import norm2
from oculith.operators import matrices

#: Which image axis the screen's x, the screen's y and the slice number run along, by plane.
AXES = {"AXIAL": (0, 1, 2), "SAGITTAL": (1, 2, 0), "CORONAL": (0, 2, 1)}


@dataclass(frozen=True)
class Volume:
    """Size, voxel spacing and affine (translation in the last column) of a volume; plain numbers, fixed at plan time."""

    dims: tuple[int, int, int]
    pixdim: tuple[float, float, float] = (1.0, 1.0, 1.0)
    affine: tuple[tuple[float, ...], ...] = ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0))

    def matrix(self) -> np.ndarray:
        return np.array(self.affine, float)

    def inverse(self) -> np.ndarray:
        if abs(np.linalg.det(self.matrix())) < 1e-10:
            raise ValueError("the affine can't be inverted")
        return np.linalg.inv(self.matrix())

    def frac2mm(self) -> np.ndarray:
        """From fractions of the volume to millimetres: voxel centres lie half a voxel inside."""
        return self.matrix() @ np.array([[self.dims[0], 0, 0, -0.5], [0, self.dims[1], 0, -0.5], [0, 0, self.dims[2], -0.5], [0, 0, 0, 1]])

    def ortho(self) -> np.ndarray:
        """From fractions to millimetres of the unrotated volume: the spacing alone scales, and the world's origin stays."""
        origin = (self.inverse() @ [0.0, 0.0, 0.0, 1.0])[:3]
        out = np.diag([*(p * n for p, n in zip(self.pixdim, self.dims)), 1.0])
        out[:3, 3] = [(-o - 0.5) * p for o, p in zip(origin, self.pixdim)]
        return out

    def extents(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest corner of the unrotated volume."""
        m = self.ortho()
        return m[:3, 3], m[:3, 3] + np.diag(m)[:3]


def transform(m: np.ndarray, *xyz: Column) -> list[Column]:
    """Affine product as three expressions with literal weights."""
    return [sum((float(m[r, c]) * xyz[c] for c in range(1, 3)), float(m[r, 0]) * xyz[0]) + float(m[r, 3]) for r in range(3)]


def slice_number(index: Column | str, plane: Column | str, dims: tuple[int, int, int]) -> Column:
    """Number of the slice (from 1) by its plane's size, rounded half to even; null for other planes."""
    index, plane = (F.col(x) if isinstance(x, str) else x for x in (index, plane))
    at = F.when(plane == "AXIAL", dims[2] - 1).when(plane == "SAGITTAL", dims[0] - 1).when(plane == "CORONAL", dims[1] - 1)
    return (F.rint(index * at) + 1).cast("int")


def slice_of(index: Column, n: int, method: str = "round") -> Column:
    """Slice number (from 1) of a normalised index, clamped at both ends."""
    if n < 1:
        raise ValueError("a volume has at least one slice")
    at = F.least(F.greatest(index, F.lit(0.0)), F.lit(1.0)) * float(n - 1)
    step = {"round": F.rint, "floor": F.floor, "ceiling": F.ceil}[method]
    return F.least(F.greatest(step(at).cast("int") + 1, F.lit(1)), F.lit(n))


def index_of(number: Column, n: int) -> Column:
    return F.lit(0.5) if n == 1 else (number - 1) / float(n - 1)


def located(df: DataFrame, volume: Volume, x: str = "gaze_x", y: str = "gaze_y", number: str = "slice_num", plane: str = "plane") -> DataFrame:
    """voxel_i, voxel_j, voxel_k (from 0), mm_x, mm_y, mm_z, valid: position on a slice, clamped to the image, in the
    volume's own axes. Null for unknown planes and null positions."""
    clamp = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)))
    sources = (clamp(x), clamp(y), None)
    voxel, frac = [], []
    for axis in range(3):
        v = f = None
        for name, axes in AXES.items():
            k = axes.index(axis)
            own = F.rint(sources[k] * float(volume.dims[axis] - 1)) if k < 2 else F.col(number) - 1.0
            share = sources[k] if k < 2 else index_of(F.col(number), volume.dims[axis])
            hit = F.col(plane) == name
            v, f = (F.when(hit, own), F.when(hit, share)) if v is None else (v.when(hit, own), f.when(hit, share))
        voxel.append(v.cast("int"))
        frac.append(f)
    valid = F.lit(True)
    for v, n in zip(voxel, volume.dims):
        valid = valid & v.between(0, n - 1)
    mm = transform(volume.frac2mm(), *frac)
    return df.withColumns(dict(zip(("voxel_i", "voxel_j", "voxel_k"), voxel)) | dict(zip(("mm_x", "mm_y", "mm_z"), mm)) | {"valid": F.coalesce(valid, F.lit(False))})


def anatomy(integrated: DataFrame, volume: Volume, axis_order: str = "screen") -> DataFrame:
    """slice_num, voxel_x, voxel_y, voxel_z (from 0), frac_x, frac_y, frac_z, world_x, world_y, world_z of the samples
    inside the image. "screen" leaves the voxel in screen order (x, y, slice) on every plane; "anatomical" gives the
    volume's own axes. Null on unknown planes."""
    if axis_order not in ("screen", "anatomical"):
        raise ValueError(f"unknown axis order: {axis_order}")
    df = integrated.filter("within_bounds").withColumn("slice_num", slice_number("slice_index", "plane", volume.dims))
    pick = lambda place: F.coalesce(*[F.when(F.col("plane") == name, F.lit(volume.dims[axes[place]] - 1.0)) for name, axes in AXES.items()])
    df = df.withColumns({"voxel_x": F.rint(F.col("gaze_x_adjusted") * pick(0)), "voxel_y": F.rint(F.col("gaze_y_adjusted") * pick(1)), "voxel_z": F.col("slice_num") - 1.0})
    if axis_order == "anatomical":
        order = {f"voxel_{name}": F.coalesce(*[F.when(F.col("plane") == plane, F.col(f"voxel_{'xyz'[axes.index(axis)]}")) for plane, axes in AXES.items()]) for axis, name in enumerate("xyz")}
        df = df.withColumns(order)
    df = df.withColumns({f"frac_{c}": F.col(f"voxel_{c}") / float(n - 1) for c, n in zip("xyz", volume.dims)})
    return df.withColumns(dict(zip(("world_x", "world_y", "world_z"), transform(volume.frac2mm(), F.col("frac_x"), F.col("frac_y"), F.col("frac_z")))))


def picked(points: DataFrame, volume: Volume, x: str = "x", y: str = "y", number: str = "slice_num") -> DataFrame:
    """voxel_i, voxel_j, voxel_k (from 0), world_x, world_y, world_z of points on axial slices; points off the slice are
    left out."""
    i, j = F.rint(F.col(x) * (volume.dims[0] - 1.0)), F.rint(F.col(y) * (volume.dims[1] - 1.0))
    df = points.withColumns({"voxel_i": i.cast("int"), "voxel_j": j.cast("int"), "voxel_k": F.col(number) - 1}).filter(F.col("voxel_i").between(0, volume.dims[0] - 1) & F.col("voxel_j").between(0, volume.dims[1] - 1))
    share = [F.col(c) / float(n) for c, n in zip(("voxel_i", "voxel_j", "voxel_k"), volume.dims)]
    return df.withColumns(dict(zip(("world_x", "world_y", "world_z"), transform(volume.ortho(), *share))))


#: Size of the browser frame, of the canvas inside it, and the canvas's left and upper border, in pixels.
FRAME, CANVAS, BORDER = (2624, 1640), (1924, 1560), (350, 80)


def canvas(x: Column, y: Column, frame: tuple[float, float] = FRAME, size: tuple[float, float] = CANVAS, border: tuple[float, float] = BORDER) -> tuple[Column, Column]:
    """Display coordinates to those of the canvas inside the browser frame."""
    return (x * frame[0] - border[0]) / size[0], (y * frame[1] - border[1]) / size[1]


def letterbox(display_aspect: float, image_aspect: float) -> dict[str, float]:
    """Bounds of an image that fills the display's height (or its width, if wider than the display), centred."""
    across, down = min(1.0, image_aspect / display_aspect), min(1.0, display_aspect / image_aspect)
    return {"left": (1 - across) / 2, "right": (1 + across) / 2, "top": (1 - down) / 2, "bottom": (1 + down) / 2}


def anisotropy(sizes: Column) -> Column:
    """Largest over smallest of voxel sizes written as "AxBxC"; null where one isn't a number."""
    parts = F.transform(F.split(sizes, "x"), lambda x: x.try_cast("double"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), F.try_divide(F.array_max(parts), F.array_min(parts)))


def orientation_class(orientation: Column, oblique: Column) -> Column:
    return F.when(oblique, "Oblique").when(orientation.isin("RAS", "LPS", "LAS", "RPI"), orientation).otherwise("Other")


def axis_of(plane: Column, place: int) -> Column:
    """Number (from 0) of the image axis along the screen's x (0), y (1) or the slices (2); null for other planes."""
    return F.coalesce(*[F.when(plane == name, F.lit(axes[place])) for name, axes in AXES.items()])


def _axes(plane: Column, x: Column, y: Column, z: Column) -> list[Column]:
    """Values along the screen's x, y and the slices, in the order of the image's axes."""
    return [F.coalesce(*[F.when(plane == name, (x, y, z)[axes.index(axis)]) for name, axes in AXES.items()]) for axis in range(3)]


def round_trips(df: DataFrame, x: str = "gaze_x", y: str = "gaze_y", index: str = "slice_index", plane: str = "plane") -> DataFrame:
    """Screen to voxel, to the world by the row's own volume (columns dims, affine, inverse) and back.

    slice_num, voxel_i, voxel_j, voxel_k, world_x, world_y, world_z, and how far the way back ends from the start:
    voxel_error (voxels, in the slice), mm_error (in the world) and screen_error (of the screen's 0 to 1). Null for unknown
    planes, null positions and volumes that can't be inverted.
    """
    own = F.col(plane)
    last = lambda place: F.col("dims")[axis_of(own, place)] - 1.0
    clamp = lambda c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)))
    df = df.withColumns({"_nx": last(0), "_ny": last(1), "_at": F.rint(F.col(index) * last(2))})
    df = df.withColumns({"_x": clamp(x) * F.col("_nx"), "_y": clamp(y) * F.col("_ny")})
    voxel = _axes(own, F.rint("_x"), F.rint("_y"), F.col("_at"))
    df = df.withColumns({"slice_num": (F.col("_at") + 1).cast("int")} | dict(zip(("_i", "_j", "_k"), voxel)))
    ijk = [F.col(c) for c in ("_i", "_j", "_k")]
    df = df.withColumns(dict(zip(("world_x", "world_y", "world_z"), matrices.applied(F.col("affine"), *ijk))))
    df = df.withColumns(dict(zip(("_bi", "_bj", "_bk"), matrices.applied(F.col("inverse"), F.col("world_x"), F.col("world_y"), F.col("world_z")))))
    back = [F.coalesce(*[F.when(own == name, F.col(("_bi", "_bj", "_bk")[axes[place]])) for name, axes in AXES.items()]) for place in range(2)]
    df = df.withColumns({"_dx": F.col("_x") - back[0], "_dy": F.col("_y") - back[1]})
    off = _axes(own, F.col("_dx"), F.col("_dy"), F.lit(0.0))
    mm = [sum((F.col("affine")[r][c] * off[c] for c in (1, 2)), F.col("affine")[r][0] * off[0]) for r in range(3)]
    df = df.withColumns({"voxel_error": norm2(F.col("_dx"), F.col("_dy")), "mm_error": norm2(*mm), "screen_error": norm2(F.try_divide("_dx", "_nx"), F.try_divide("_dy", "_ny"))})
    df = df.withColumns({f"voxel_{a}": F.col(f"_{a}").cast("int") for a in "ijk"})
    return df.drop("_nx", "_ny", "_at", "_x", "_y", "_i", "_j", "_k", "_bi", "_bj", "_bk", "_dx", "_dy")
