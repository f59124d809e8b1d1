"""Order-dependent work on sessions of any length: no task holds a whole session.

Rows are numbered by counting them in cells of time, summing the counts of the cells before, and ranking inside each
cell. Once rows have numbers, they are dealt in blocks of equal size; neighbours come from a halo of rows that is dealt
to the blocks on either side, and running values from one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oculith.functions.columns import rows

SESSION = ("session_id",)
ORDER = ("time_sec", "gaze_id")
#: Rows of a block, and seconds of a cell.
BLOCK, SECONDS = 65_536, 30.0


def cell_of(time: Column | str, seconds: float = SECONDS) -> Column:
    return F.floor((F.col(time) if isinstance(time, str) else time) / F.lit(seconds)).cast("long")


def numbered(df: DataFrame, keys: tuple[str, ...], order: tuple[Column | str, ...], cell: Column, name: str = "row", total: str | None = None, least: tuple[str, Column] | None = None) -> DataFrame:
    """`name`: the row's number (from 1) within its keys by `order`; `cell` never falls along that order.

    `total` adds the number of rows of the keys, `least` (name, column) the smallest value of a column among them. The
    rows of a cell are ranked in one task; of other cells it needs one row each.
    """
    marked = df.withColumn("__cell", F.coalesce(cell, F.lit(-(1 << 62))))
    low = F.min(least[1]) if least else F.lit(None)
    cells = marked.groupBy(*keys, "__cell").agg(rows().alias("__n"), low.alias("__low"))
    own, so_far = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    more = ([F.sum("__n").over(own).alias(total)] if total else []) + ([F.min("__low").over(own).alias(least[0])] if least else [])
    cells = cells.select(*keys, "__cell", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__before"), *more)
    rank = F.row_number().over(Window.partitionBy(*keys, "__cell").orderBy(*order))
    return marked.join(cells, [*keys, "__cell"]).withColumn(name, F.col("__before") + rank).drop("__cell", "__before")


def dense(df: DataFrame, time: str = "time_sec", tie: str = "gaze_id", keys: tuple[str, ...] = SESSION, name: str = "__row", total: str | None = None) -> DataFrame:
    """numbered() by time, for rows that have lost some of theirs, so that ids have gaps."""
    return numbered(df, keys, (time, tie), cell_of(time), name, total)


def over(df: DataFrame, *steps: Callable, before: int = 0, after: int = 0, keys: tuple[str, ...] = SESSION, row: str = "gaze_id", size: int | None = None, keep: bool = False) -> DataFrame:
    """df with the columns that each step makes, in turn, of a window in row order.

    The window holds a block of rows and, beside it, `before` rows on the one side and `after` on the other; `row`
    numbers the rows of the keys without gaps. With `keep` the block's number stays, as column __block.
    """
    at, size = F.col(row) - 1, size or BLOCK
    block = F.floor(at / F.lit(size)).cast("long")
    to = [block]
    if before:
        to.append(F.when(at % size >= size - before, block + 1))
    if after:
        to.append(F.when((at % size < after) & (at >= size), block - 1))
    wide = df.withColumn("__block", F.explode(F.array_compact(F.array(*to))) if len(to) > 1 else block)
    w = Window.partitionBy(*keys, "__block").orderBy(row)
    for step in steps:
        wide = wide.withColumns(step(w))
    own = wide.filter(F.col("__block") == block) if len(to) > 1 else wide
    return own if keep else own.drop("__block")


def running(df: DataFrame, name: str, value: Column, fold: Callable[[Column], Column] = F.sum, keys: tuple[str, ...] = SESSION, row: str = "gaze_id", size: int | None = None) -> DataFrame:
    """`name`: the sum (or F.max, F.min) of a value over the rows of the keys so far. Each block adds one row to what the
    blocks before it leave behind."""
    marked = over(df.withColumn("__value", value), keys=keys, row=row, size=size, keep=True)
    ends = marked.groupBy(*keys, "__block").agg(fold(F.col("__value")).alias("__end"))
    left = fold(F.col("__end")).over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*keys, "__block", left.alias("__left"))
    inside = fold(F.col("__value")).over(Window.partitionBy(*keys, "__block").orderBy(row).rowsBetween(Window.unboundedPreceding, 0))
    joined = marked.join(ends, [*keys, "__block"]).withColumn("__inside", inside)
    both = {F.sum: lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b), F.max: F.greatest, F.min: F.least}[fold]
    return joined.withColumn(name, both(F.col("__left"), F.col("__inside"))).drop("__value", "__block", "__left", "__inside")


def islands(df: DataFrame, starts: Callable, flag: str, time: str = "time_sec", keys: tuple[str, ...] = SESSION, row: str = "gaze_id", size: int | None = None) -> DataFrame:
    """island: how many rows so far start an island (`starts`: a function of a window that may look one row back);
    island_rows, island_low, island_high: number, first and last time of the island's rows where `flag` holds.

    An island may span any number of blocks. Only its first and last piece in a block touch other blocks, so what pieces
    add up to is worked out on two rows a block.
    """
    marked = over(df, lambda w: {"__start": starts(w).cast("long")}, before=1, keys=keys, row=row, size=size, keep=True)
    block = Window.partitionBy(*keys, "__block")
    marked = marked.withColumn("__c", F.sum("__start").over(block.orderBy(row).rowsBetween(Window.unboundedPreceding, 0)))
    marked = marked.withColumn("__most", F.max("__c").over(block))
    on = lambda place: F.when(place & F.col(flag), F.col(time))
    head, tail = F.col("__c") == 0, (F.col("__c") == F.col("__most")) & (F.col("__most") > 0)
    sums = [f(on(place)).alias(f"__{n}{k}") for k, place in enumerate((head, tail)) for n, f in (("rows", F.count), ("low", F.min), ("high", F.max))]
    edges = marked.groupBy(*keys, "__block").agg(F.max("__most").alias("__most"), *sums)
    before = F.coalesce(F.sum("__most").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.withColumn("__before", before)
    piece = lambda k: F.struct(F.lit(k).alias("k"), (F.col("__before") + (F.col("__most") if k else 0)).alias("g"), *[F.col(f"__{n}{k}").alias(n) for n in ("rows", "low", "high")])
    pieces = edges.select(*keys, "__block", "__before", F.explode(F.array(piece(0), piece(1))).alias("p"))
    whole = Window.partitionBy(*keys, "p.g")
    pieces = pieces.withColumn("all", F.struct(F.sum("p.rows").over(whole).alias("rows"), F.min("p.low").over(whole).alias("low"), F.max("p.high").over(whole).alias("high")))
    ends = pieces.groupBy(*keys, "__block", "__before").agg(*[F.max(F.when(F.col("p.k") == k, F.col("all"))).alias(f"__all{k}") for k in (0, 1)])
    inside = Window.partitionBy(*keys, "__block", "__c")
    own = F.struct(F.count(on(F.lit(True))).over(inside).alias("rows"), F.min(on(F.lit(True))).over(inside).alias("low"), F.max(on(F.lit(True))).over(inside).alias("high"))
    joined = marked.join(ends, [*keys, "__block"]).withColumn("__own", F.when(head, F.col("__all0")).when(tail, F.col("__all1")).otherwise(own))
    joined = joined.withColumns({"island": F.col("__before") + F.col("__c"), **{f"island_{n}": F.col(f"__own.{n}") for n in ("rows", "low", "high")}})
    return joined.drop("__block", "__start", "__c", "__most", "__before", "__all0", "__all1", "__own")


def tile(n: int, row: Column, total: Column) -> Column:
    """Number (from 1) of the n parts of nearly equal size that a row falls in; the first parts take what is left over."""
    size, extra = F.floor(total / F.lit(n)), total % n
    wide = extra * (size + 1)
    at = F.when(row <= wide, F.floor((row - 1) / (size + 1))).otherwise(extra + F.floor(F.try_divide(row - 1 - wide, size)))
    return (at + 1).cast("int")


def with_stats(df: DataFrame, keys: tuple[str, ...], **stats: Column) -> DataFrame:
    """df with aggregates of its keys: partial sums, joined back, instead of a window that holds all rows of a key."""
    return df.join(df.groupBy(*keys).agg(*[c.alias(k) for k, c in stats.items()]), list(keys))


def quantiles(df: DataFrame, value: str, probabilities: tuple[float, ...], keys: tuple[str, ...] = SESSION, name: str = "q", cells: int = 256) -> DataFrame:
    """keys and `name`: the exact quantiles (linear between ranks) of each key's values, null values left out.

    Approximate quantiles cut each key's values into cells; counts of the cells name those that hold the ranks wanted, and
    only their rows are ranked. Keys without a value have no row.
    """
    if not keys:
        return quantiles(df.withColumn("__all_rows", F.lit(0)), value, probabilities, ("__all_rows",), name, cells).drop("__all_rows")
    known = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v is not null")
    cuts = known.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.percentile_approx("v", F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(8 * cells)))).alias("__cuts"))
    # How many cuts lie below a value, by halves; a value that is itself a cut closes its cell.
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(cells.bit_length()))])
    cell = F.aggregate(halves, F.lit(0), lambda below, step: below + F.when(F.get("__cuts", below + step - 1) < F.col("v"), step).otherwise(F.lit(0)))
    placed = known.join(cuts, list(keys)).select(*keys, cell.alias("__cell"), "v")
    values = placed.groupBy(*keys, "__cell", "v").agg(rows().alias("n"))
    counts = values.groupBy(*keys, "__cell").agg(F.sum("n").alias("n"))
    so_far = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__cell", "n", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy(*keys)).alias("__all"))
    at = [(F.col("__all") - 1) * F.lit(float(p)) for p in probabilities]
    wanted = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    inside = F.filter(wanted, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("n")))
    hit = counts.select(*keys, "__cell", "__before", "__all", inside.alias("__ranks")).filter(F.size("__ranks") > 0)
    upto = F.sum("n").over(Window.partitionBy(*keys, "__cell").orderBy("v"))
    ranked = values.join(hit, [*keys, "__cell"]).withColumn("__upto", F.col("__before") + upto)
    found = ranked.select(*keys, "__all", "v", F.explode(F.filter("__ranks", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("n")))).alias("__rank"))
    table = found.groupBy(*keys, "__all").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "v"))).alias("__at"))
    pick = lambda x: F.element_at("__at", F.floor(x).cast("long")) + (x - F.floor(x)) * (F.element_at("__at", F.ceil(x).cast("long")) - F.element_at("__at", F.floor(x).cast("long")))
    return table.select(*keys, F.array(*map(pick, at)).alias(name))
