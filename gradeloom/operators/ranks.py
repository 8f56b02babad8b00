"""Exact running counts, ranks and percentiles of long columns, where no task sees a whole column.

Distinct values with their counts are dealt to ranges between approximate quantiles of their key's values. A running count is made
within each range and starts at the sum of the ranges before it, so however uneven the values, a task sorts about one part in RANGES
of a key's distinct values. Where there are FEW distinct values in all, one window a key gives the same. Rows whose key is null are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import settled

#: Ranges of each key, a power of two.
RANGES = 128
#: Distinct values, of all keys together, that one task may sort.
FEW = 500_000
#: A key with more than one in HOT of all rows is frequent: there are fewer than HOT of them.
HOT = 2000
#: Rows of a table of values with a rank that are broadcast together (some 90 MB of hashed rows).
WHOLE = 750_000


def _place(value: Column, bounds: Column) -> Column:
    """How many of the sorted bounds are less than the value, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(RANGES.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(bounds, at + step) < value, at + step).otherwise(at))


def running_counts(cells: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    """`cells`, distinct (keys, value) with counts, and `before`: the counts of the key's smaller values together."""
    if not keys:
        return running_counts(cells.withColumn("__all", F.lit(1)), ["__all"], value, count).drop("__all")
    cells = settled(cells.dropna(subset=keys))
    upto = lambda over, what: F.coalesce(F.sum(what).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if cells.count() <= FEW:
        return cells.withColumn("before", upto(Window.partitionBy(*keys).orderBy(value), count))
    shares = [i / RANGES for i in range(1, RANGES)]
    # approximate bounds follow the order in which parts arrive; they are used twice below, and must be the same both times
    bounds = settled(cells.groupBy(*keys).agg(F.percentile_approx(value, shares, 20 * RANGES).alias("__bounds")))
    placed = cells.join(bounds, keys).withColumn("__range", _place(F.col(value), F.col("__bounds"))).drop("__bounds")
    sums = placed.groupBy(*keys, "__range").agg(F.sum(count).alias("__sum"))  # RANGES rows a key at most
    starts = sums.select(*keys, "__range", upto(Window.partitionBy(*keys).orderBy("__range"), "__sum").alias("__start"))
    inside = upto(Window.partitionBy(*keys, "__range").orderBy(value), count)
    return placed.withColumn("__inside", inside).join(starts, [*keys, "__range"]).select(*cells.columns, (F.col("__start") + F.col("__inside")).alias("before"))


def average_rank(rows: DataFrame, keys: list[str], value: str, count: str = "n", few: bool = False) -> DataFrame:
    """(keys, value, rank) for distinct values with their counts: ties share the mean of their places.

    `few` says that a key has few distinct values (grades), which one window holds.
    """
    cells = rows.groupBy(*keys, value).agg(F.sum(count).alias(count))
    if few:
        before = F.sum(count).over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.withColumn("before", F.coalesce(before, F.lit(0)))
    else:
        cells = running_counts(cells, keys, value, count)
    return cells.select(*keys, value, (F.col("before") + (F.col(count) + 1) / 2).alias("rank"))


def attached(rows: DataFrame, table: DataFrame, keys: list[str], count: str = "n", whole: int = 0) -> DataFrame:
    """`rows` with the columns of `table`, which has a row for each `keys` and in `count` how many rows have them; rows without one go.

    A table of up to `whole` rows is broadcast. Of a larger one the frequent keys are, so that their rows stay where they are; the others meet
    in a join, where none has more than one in HOT of all rows. `rows` are read twice then, so they should be settled.
    """
    total, size = table.agg(F.coalesce(F.sum(count), F.lit(0)), F.count(F.lit(1))).first()
    if size <= whole:
        return rows.join(F.broadcast(table.drop(count)), keys)
    often = F.col(count) * HOT > F.lit(total)
    hot, rest = F.broadcast(table.where(often).drop(count)), table.where(~often).drop(count)
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(rest, keys))


def with_rank(rows: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """`rows` with the average rank of `value` within `keys`; rows where either is null or NaN go. Equal values may be any number of rows."""
    rows = settled(rows.dropna(subset=[*keys, value]))
    run = running_counts(rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")), keys, value, "__n")
    table = settled(run.select(*keys, value, "__n", (F.col("before") + (F.col("__n") + 1) / 2).alias(name)))
    return attached(rows, table, [*keys, value], "__n", WHOLE)


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float], name: str = "q") -> DataFrame:
    """(keys, name): array of exact percentiles, between neighbours by linear interpolation; nulls do not count."""
    if not keys:
        return percentiles(rows.withColumn("__all", F.lit(1)), ["__all"], value, shares, name).drop("__all")
    cells = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    run = running_counts(cells, keys, "__v", "__n")
    run = run.join(run.groupBy(*keys).agg(F.sum("__n").alias("__total")), keys)
    places = [F.lit(float(s)) * (F.col("__total") - 1) for s in shares]
    # the value at place i is the largest with no more than i values before it
    at = lambda place: F.max(F.when(F.col("before") <= place, F.col("__v")))
    ends = [f(F.round(p, 9)) for p in places for f in (F.floor, F.ceil)]
    found = run.groupBy(*keys).agg(F.max("__total").alias("__total"), *[at(e).alias(f"__{i}") for i, e in enumerate(ends)])
    between = [F.col(f"__{2 * i}") + (p - F.floor(F.round(p, 9))) * (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}")) for i, p in enumerate(places)]
    return found.select(*keys, F.array(*between).alias(name))


def median(rows: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """(keys, name): exact medians."""
    return percentiles(rows, keys, value, [0.5], name).withColumn(name, F.col(name)[0])
