"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents are summed once to cells (source, language, topic). Each margin has a target share for each of its values; a
value can't give more tokens than it has, so what it lacks is spread over the others of its margin in proportion (its
goal). Cells of a value that must give all it has are taken whole. Raking scales the token weights of the others to what
is left of the goals of each margin in turn, and holds every cell to the tokens that it has, until no goal is missed by
more than a tolerance. It runs on cells only, by partial sums, whatever their number.
A document is then sampled with its cell's probability, by a hash of its id, so that reruns and recomputed tasks decide
alike. margins() reports what was wanted, what is feasible and what is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oculith.llm.shared import written

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
#: Production parameters: where no targets are given, each margin's own shares to a power below 1, so that rare values
#: gain; the share of all tokens to sample.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
FRACTION = 0.5
#: Most rounds of raking, and the share of its goal by which a value may miss it.
ROUNDS, TOLERANCE = 12, 2e-3
#: Target shares by margin and value; values that aren't named have none.
Targets = dict[str, dict[str, float]]


def topic_of(text: Column) -> Column:
    """A topic from the form of a text, where documents carry none: tabular, shouted, contact, licensing or prose."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "tabular")
        .when(F.contains(text, F.lit("!! ")), "shouted")
        .when(F.contains(text, F.lit("@")), "contact")
        .when(F.contains(text, F.lit("icense")), "licensing")
        .otherwise("prose")
    )


def measured(docs: DataFrame, topic: Column | None = None, *more: Column) -> DataFrame:
    """doc_id, source, lang, topic, tokens (words; at least 1) of each document, and `more` columns."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    margin = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(NONE)).alias(name)
    tokens = F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")
    topic = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(NONE))
    return docs.select("doc_id", margin("source"), margin("lang"), topic.alias("topic"), tokens.alias("tokens"), *more)


def level(values: DataFrame, budget: float) -> float:
    """The factor by which shares become goals: least(factor * share, tokens) sums to the budget, or to all tokens.

    Values that can't give their part are found round by round; only their sums come to the driver.
    """
    factor = 0.0
    while True:
        full = F.col("share") * factor >= F.col("tokens")
        spent, open_, n = values.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).cast("double"), F.coalesce(F.sum(F.when(~full, F.col("share"))), F.lit(0.0)), F.count_if(full)).first()
        if not open_:
            return factor
        now = (budget - spent) / open_
        if now <= factor * (1 + 1e-12):
            return factor
        factor = now


def goals(cells: DataFrame, fraction: float, powers: dict[str, float], targets: Targets | None) -> dict[str, DataFrame]:
    """For each margin its values with `tokens`, `wanted` (by their shares alone) and `goal` (feasible)."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    found = {}
    for name in MARGINS:
        values = cells.groupBy(name).agg(F.sum("tokens").alias("tokens"))
        own = (targets or {}).get(name)
        if own:
            share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in (pair[0], float(pair[1]))]), F.col(name)), F.lit(0.0))
        else:
            share = F.pow(F.col("tokens").cast("double"), F.lit(float(powers[name])))
        values = written(values.withColumn("share", share), f"margin-{name}")
        whole = values.agg(F.sum("share")).first()[0] or 1.0
        factor = level(values, fraction * total)
        found[name] = values.select(name, "tokens", (F.col("share") * (fraction * total / whole)).alias("wanted"), F.least(F.col("share") * factor, F.col("tokens").cast("double")).alias("goal"))
    return found


def rake(cells: DataFrame, fraction: float = FRACTION, powers: dict[str, float] = POWERS, targets: Targets | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight: tokens to sample, 0 <= weight <= tokens.

    Stops once every value of every margin is within the tolerance of its goal, or after `rounds` rounds (goals of
    different margins can contradict each other). The sums of a margin are joined back, so that no task holds all cells
    of a common value; every step is written, so that plans stay small.
    """
    goal, marked = goals(cells, fraction, powers, targets), cells.withColumn("full", F.lit(False))
    for name in MARGINS:
        spent = goal[name].select(name, (F.col("goal") >= F.col("tokens")).alias("all"))
        marked = marked.join(spent, name).select(*MARGINS, "tokens", (F.col("full") | F.col("all")).alias("full"))
    marked = written(marked, "marked")
    rest = {}
    for name in MARGINS:
        taken = marked.filter("full").groupBy(name).agg(F.sum("tokens").alias("taken"))
        left = goal[name].join(taken, name, "left").select(name, F.greatest(F.col("goal") - F.coalesce("taken", F.lit(0)), F.lit(0.0)).alias("rest"), "goal")
        rest[name] = written(left, f"rest-{name}")
    free = marked.filter("not full").select(*MARGINS, "tokens", (fraction * F.col("tokens").cast("double")).alias("weight"))
    for round_ in range(rounds):
        for name in MARGINS:
            held = free.groupBy(name).agg(F.sum("weight").alias("held"))
            scale = held.join(rest[name], name).select(name, F.coalesce(F.try_divide("rest", "held"), F.lit(0.0)).alias("scale"))
            free = free.join(scale, name).select(*MARGINS, "tokens", F.least(F.col("weight") * F.col("scale"), F.col("tokens").cast("double")).alias("weight"))
            free = written(free, "raked")
        if round_ < rounds - 1 and missed(free, rest) <= tolerance:
            break
    return free.unionByName(marked.filter("full").select(*MARGINS, "tokens", F.col("tokens").cast("double").alias("weight")))


def missed(free: DataFrame, rest: dict[str, DataFrame]) -> float:
    """The largest share of its goal by which a value of any margin misses what is left of it."""
    off = None
    for name in MARGINS:
        held = free.groupBy(name).agg(F.sum("weight").alias("held")).join(rest[name], name)
        part = held.select((F.abs(F.col("held") - F.col("rest")) / F.greatest(F.col("goal"), F.lit(1.0))).alias("off"))
        off = part if off is None else off.unionByName(part)
    return off.agg(F.max("off")).first()[0] or 0.0


def margins(cells: DataFrame, raked: DataFrame, fraction: float = FRACTION, powers: dict[str, float] = POWERS, targets: Targets | None = None) -> DataFrame:
    """margin, value, tokens, wanted, goal, reached (tokens, in expectation) of every value."""
    goal, out = goals(cells, fraction, powers, targets), None
    for name in MARGINS:
        reached = raked.groupBy(name).agg(F.sum("weight").alias("reached")).join(goal[name], name)
        part = reached.select(F.lit(name).alias("margin"), F.col(name).alias("value"), "tokens", "wanted", "goal", "reached")
        out = part if out is None else out.unionByName(part)
    return out


def cells_of(rows: DataFrame) -> DataFrame:
    return written(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")


def probabilities(rows: DataFrame, fraction: float, powers: dict[str, float], targets: Targets | None) -> DataFrame:
    """source, lang, topic, probability of each cell of measured() rows."""
    return rake(cells_of(rows), fraction, powers, targets).select(*MARGINS, (F.col("weight") / F.col("tokens")).alias("probability"))


def chance() -> Column:
    """A number from 0 to 1 by a hash of doc_id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, fraction: float = FRACTION, powers: dict[str, float] = POWERS, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability, sampled.

    `targets` names shares of the values of a margin; margins without have their own shares to a power. `topic` is an
    expression over the documents, by default the form of the text. Null source and lang form a value of their own; an
    empty or null text counts one token; texts of any length are counted whole. Rows that repeat a doc_id have the same
    chance. Other columns are ignored; an empty table gives no rows.
    """
    rows = written(measured(docs, topic), "measured")
    joined = rows.join(probabilities(rows, fraction, powers, targets), list(MARGINS))  # AQE broadcasts the cells if they are small, else it can split hot ones
    return joined.select("doc_id", *MARGINS, "tokens", "probability", (chance() < F.col("probability")).alias("sampled"))


def keep_sampled(docs: DataFrame, fraction: float = FRACTION, powers: dict[str, float] = POWERS, targets: Targets | None = None, topic: Column | None = None) -> DataFrame:
    """The rows that mix() samples, whole: each is filtered by its own cell's probability, so null and repeated ids need
    no join back, and other columns may have any names. An empty table gives no rows."""
    rows = measured(docs, topic, F.struct("*").alias("whole"))
    joined = rows.join(probabilities(measured(docs, topic), fraction, powers, targets), list(MARGINS))
    return joined.filter(chance() < F.col("probability")).select("whole.*")
