"""4 x 4 matrices as data: `array<array<double>>` columns of rows, so that every row of a table can have its own affine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oculith.functions.columns import col

#: Determinants nearer to 0 than this count as none.
SINGULAR = 1e-10
N = range(4)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def matrix(rows: list[list[Column | float]]) -> Column:
    return F.array(*[F.array(*[col(v).cast("double") for v in row]) for row in rows])


def identity() -> Column:
    return matrix([[float(r == c) for c in N] for r in N])


def rotation(axis: str, cosine: Column | float, sine: Column | float) -> Column:
    """Turn around x, y or z by an angle given as cosine and sine."""
    a, b = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    at = {(a, a): col(cosine), (b, b): col(cosine), (a, b): -col(sine), (b, a): col(sine)}
    return matrix([[at.get((r, c), float(r == c)) for c in N] for r in N])


def transpose(m: Column) -> Column:
    return matrix([[m[c][r] for c in N] for r in N])


def product(a: Column, b: Column) -> Column:
    """a times b: what b does comes first."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda m: matrix([[sum((m["a"][r][k] * m["b"][k][c] for k in range(1, 4)), m["a"][r][0] * m["b"][0][c]) for c in N] for r in N]))


def translated(m: Column, *xyz: Column | float) -> Column:
    """m after a shift: m times the shift's matrix."""
    return let(m, lambda a: matrix([[*(a[r][c] for c in range(3)), sum((a[r][c] * col(v) for c, v in enumerate(xyz)), a[r][3])] for r in N]))


def scaled(m: Column, *xyz: Column | float) -> Column:
    """m with its first three columns multiplied."""
    return let(m, lambda a: matrix([[*(a[r][c] * col(v) for c, v in enumerate(xyz)), a[r][3]] for r in N]))


def _minors(m: Column, top: int) -> dict[tuple[int, int], Column]:
    """2 x 2 determinants of rows top and top + 1, by their columns."""
    return {(c, d): m[top][c] * m[top + 1][d] - m[top][d] * m[top + 1][c] for c in N for d in range(c + 1, 4)}


def _expand(upper: Column, lower: Column) -> Column:
    """Laplace's expansion of the determinant over the first two rows."""
    total, pairs = None, [(c, d) for c in N for d in range(c + 1, 4)]
    for c, d in pairs:
        rest = tuple(sorted({0, 1, 2, 3} - {c, d}))
        term = upper[f"{c}{d}"] * lower[f"{rest[0]}{rest[1]}"] * float((-1) ** (c + d + 1))
        total = term if total is None else total + term
    return total


def _pairs(m: Column, f: Callable[[Column], Column]) -> Column:
    """f of a struct with the matrix `m`, its `upper` and `lower` minors and their determinant `det`."""
    minors = lambda a, top: F.struct(*[v.alias(f"{c}{d}") for (c, d), v in _minors(a, top).items()])
    return let(m, lambda a: let(F.struct(a.alias("m"), minors(a, 0).alias("upper"), minors(a, 2).alias("lower")), lambda p: let(F.struct(p["m"].alias("m"), p["upper"].alias("upper"), p["lower"].alias("lower"), _expand(p["upper"], p["lower"]).alias("det")), f)))


def determinant(m: Column) -> Column:
    return _pairs(m, lambda p: p["det"])


def fault(m: Column) -> Column:
    """Why a matrix can't be inverted; null where it can."""
    sized = (F.size(m) == 4) & ~F.exists(m, lambda row: row.isNull() | (F.size(row) != 4))
    finite = ~F.exists(F.flatten(m), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(m.isNull(), "no matrix").when(~sized, "not 4 x 4").when(~finite, "not finite").when(F.abs(determinant(m)) < SINGULAR, "singular")


def inverse(m: Column) -> Column:
    """The inverse by cofactors; null where the determinant is about 0."""

    def entry(p: Column, r: int, c: int) -> Column:
        # The cofactor of (c, r): its row's partner in the pair of rows, times the minors of the other pair.
        partner, other = (1 - c, p["lower"]) if c < 2 else (5 - c, p["upper"])
        x, y, z = [k for k in N if k != r]
        minor = lambda i, j: other[f"{i}{j}"]
        own = p["m"][partner]
        det3 = own[x] * minor(y, z) - own[y] * minor(x, z) + own[z] * minor(x, y)
        return det3 * float((-1) ** (r + c)) / p["det"]

    return _pairs(m, lambda p: F.when(F.abs(p["det"]) >= SINGULAR, matrix([[entry(p, r, c) for c in N] for r in N])))


def applied(m: Column, *xyz: Column) -> list[Column]:
    """The affine's image of a point, as three expressions."""
    return [sum((m[r][c] * xyz[c] for c in (1, 2)), m[r][0] * xyz[0]) + m[r][3] for r in range(3)]


def prepared(volumes: DataFrame) -> DataFrame:
    """Volumes (dims, pixdim and affine in columns) with `fault` and, where there is none, inverse, frac2mm, mm2frac, ortho
    (fractions to millimetres of the unrotated volume), and low and high, the ends of the unrotated volume."""
    dims, pix = F.col("dims"), F.col("pixdim")
    out = volumes.withColumn("fault", fault(F.col("affine")))
    good = F.col("fault").isNull()
    out = out.withColumn("inverse", F.when(good, inverse(F.col("affine"))))
    out = out.withColumn("frac2mm", F.when(good, scaled(translated(F.col("affine"), -0.5, -0.5, -0.5), *(dims[c] for c in range(3)))))
    out = out.withColumn("mm2frac", F.when(good, inverse(F.col("frac2mm"))))
    origin = lambda r: (-F.col("inverse")[r][3] - 0.5) * pix[r]
    out = out.withColumn("ortho", F.when(good, matrix([[*(pix[r] * dims[r] if r == c else 0.0 for c in range(3)), origin(r)] for r in range(3)] + [[0.0, 0.0, 0.0, 1.0]])))
    ends = lambda f: F.when(good, F.array(*[f(r) for r in range(3)]))
    return out.withColumns({"low": ends(lambda r: F.col("ortho")[r][3]), "high": ends(lambda r: F.col("ortho")[r][r] + F.col("ortho")[r][3])})
