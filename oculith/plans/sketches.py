"""Quantiles from stored sketches: one pass over the samples, then any session, day or all of them from small rows.

An answer depends on how a sketch was merged, so the SQL holds counts and extremes, which are exact, and that the rank of
each answer is off by no more than the sketch's bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oculith.functions.columns import rounded
from oculith.operators import sketches
from oculith.plans.base import SCREEN, gaze, moving, rsql, shared

LEVELS = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
TAIL = 0.02


def sketched(s, d, name: str, samples, value: str) -> DataFrame:
    """Sketches of a column, one a session and cell of time, kept beside the tables that they were made of."""
    return shared(s, d, f"sketch-{name}", lambda: sketches.sketches(samples(s, d), value), k=sketches.K, screen=SCREEN)


def ranked(samples: DataFrame, value: str, levels: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n, name, p, within: whether column `name` of the samples, the same in all rows of a key, is the p-quantile
    of the key's values but for the sketch's rank error. One pass with partial counts; no row is multiplied."""
    v = F.col(value)
    counts = [f(F.when(test, 1)).alias(f"{side}_{name}") for name in levels for side, test, f in (("under", v < F.col(name), F.count), ("upto", v <= F.col(name), F.count))]
    table = samples.groupBy(*keys).agg(F.count(v).alias("n"), *counts).filter("n > 0")
    error = sketches.rank_error() * F.col("n")
    inside = lambda name, p: (F.col(f"under_{name}") <= p * F.col("n") + error) & (F.col(f"upto_{name}") >= p * F.col("n") - error)
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), inside(name, p).alias("within")) for name, p in levels.items()])
    return table.select(*keys, "n", F.explode(each).alias("q")).select(*keys, "n", "q.*")


VELOCITIES = {f"p{p * 100:g}": p for p in LEVELS}


def velocity_sketches(s, d):
    return sketched(s, d, "velocity", moving, "velocity_deg_s")


def a12(s, d):
    """Velocity's distribution of each session from sketches of its cells."""
    table = sketches.summary(velocity_sketches(s, d), LEVELS, ("session_id",))
    beside = moving(s, d).select("session_id", "velocity_deg_s").join(table, "session_id")
    found = ranked(beside, "velocity_deg_s", VELOCITIES, ("session_id", "low", "high"))
    return rounded(found.drop("name"))


def a71(s, d):
    """Velocity's distribution over all sessions, merged from the sketches of each."""
    one = sketches.summary(sketches.merged(velocity_sketches(s, d), ("session_id",)), LEVELS).first()
    names = [*VELOCITIES, "low", "high"]
    beside = moving(s, d).select("velocity_deg_s", *[F.lit(one[c] if one else None).cast("double").alias(c) for c in names])
    return rounded(ranked(beside, "velocity_deg_s", VELOCITIES, ("low", "high")).drop("name"))


def f5(s, d):
    """The image's rectangle by session, from sketches of both coordinates."""
    bounds = sketches.image_bounds(sketched(s, d, "gaze-x", gaze, "gaze_x"), sketched(s, d, "gaze-y", gaze, "gaze_y"), tail=TAIL)
    beside = gaze(s, d).select("session_id", "gaze_x", "gaze_y").join(bounds, "session_id")
    x = ranked(beside, "gaze_x", {"left": TAIL, "right": 1 - TAIL}, ("session_id",))
    y = ranked(beside, "gaze_y", {"top": TAIL, "bottom": 1 - TAIL}, ("session_id",))
    return rounded(x.unionByName(y).withColumnRenamed("name", "edge"))


P = "(select unnest([" + ", ".join(f"{p}::double" for p in LEVELS) + "]) as p)"
VELOCITY = "(select {key} count(v) as n, min(v) as low, max(v) as high from (select session_id, velocity_deg_s as v from m where velocity_deg_s is not null) {group})"

QUERIES = {
    "a12_sketched_velocity": (a12, rsql("session_id; ~p; n; true as within; ~low; ~high", f"from {VELOCITY.format(key='session_id,', group='group by 1')} cross join {P}")),
    "a71_sketched_velocity": (a71, rsql("~p; n; true as within; ~low; ~high", f"from {VELOCITY.format(key='', group='')} cross join {P}")),
    "f5_sketched_bounds": (
        f5,
        rsql(
            "session_id; ~p; n; true as within; edge",
            f"from (select session_id, count(gaze_x) as n from g group by 1) cross join (values ('left', {TAIL}::double), ('right', {1 - TAIL}::double), ('top', {TAIL}::double), ('bottom', {1 - TAIL}::double)) as e (edge, p)",
        ),
    ),
}
