"""Cleaning, alignment, imputation, pooling and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import median


def first_values(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per key: the first value that is not null of each column, in the given order."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def align(long: DataFrame, conditions: int) -> DataFrame:
    """Only samples and features that are there under all conditions."""
    sample = ["case_id", "segment"]
    whole = long.groupBy(*sample).agg(F.count_distinct("condition").alias("k")).where(F.col("k") == conditions).select(*sample)
    names = long.groupBy("feature").agg(F.count_distinct("condition").alias("k")).where(F.col("k") == conditions).select("feature")
    return long.join(F.broadcast(names), "feature", "left_semi").join(whole, sample, "left_semi")  # a row a feature


def drop_incomplete(long: DataFrame) -> DataFrame:
    """Without the features that have a null anywhere."""
    bad = long.where(F.col("value").isNull()).select("feature").distinct()
    return long.join(bad, "feature", "left_anti")


def drop_constant(long: DataFrame, least: float = 1e-12, condition: str = "gold") -> DataFrame:
    """Only features whose sample variance under `condition` exceeds `least`."""
    kept = long.where(F.col("condition") == condition).groupBy("feature").agg(F.var_samp("value").alias("v")).where(F.col("v") > least).select("feature")
    return long.join(kept, "feature", "left_semi")


def medians(long: DataFrame, train: Column | None = None) -> DataFrame:
    """(feature, median), of the training rows if a condition is given."""
    rows = long if train is None else long.where(train)
    return median(rows, ["feature"], "value")


def impute(long: DataFrame, table: DataFrame) -> DataFrame:
    """Nulls replaced by the feature's median; features without one stay null."""
    return long.join(F.broadcast(table), "feature", "left").withColumn("value", F.coalesce("value", "median")).drop("median")  # a row a feature


#: Names of the pooled statistics.
POOLED = {"mean": "mean", "delta": "delta", "mean_minus_d": "mean_minus_d", "mean-d": "mean_minus_d", "mean_-d": "mean_minus_d"}


def pool(rows: DataFrame, key: str, columns: list[str], statistics: list[str], group: str) -> DataFrame:
    """Columns `pool_<group>_<stat>__<column>`: the patient's mean, the row's distance to it, and the mean of the other rows.

    The mean of the others needs two rows: ValueError if a patient has one and it is asked for.
    """
    stats = list(dict.fromkeys(POOLED[s.strip().lower()] for s in statistics))
    w = Window.partitionBy(key)
    if "mean_minus_d" in stats:
        alone = rows.groupBy(key).count().where("count < 2").limit(1).collect()
        if alone:
            raise ValueError(f"{key} {alone[0][0]!r} has a single row; mean_minus_d needs two")
    n = F.count(F.lit(1)).over(w)
    new = {}
    for c in columns:
        x, m = F.col(c), F.avg(c).over(w)
        for s in stats:
            new[f"pool_{group}_{s}__{c}"] = m if s == "mean" else x - m if s == "delta" else (n * m - x) / (n - 1)
    return rows.withColumns(new)


def patient_weights(rows: DataFrame, key: str) -> DataFrame:
    """1 over the number of the patient's rows."""
    return rows.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(key)))


def class_weights(rows: DataFrame, y: str, gamma: float = 1.0, largest: float = 10.0, power: float = 1.0) -> DataFrame:
    """(y, n, inverse, balanced): (1/n)^gamma scaled to 1 for the most frequent class and capped, and (n_all/(K n))^power with mean 1 over rows."""
    c = rows.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy()  # classes only
    inverse = F.pow(F.max("n").over(every) / F.col("n"), F.lit(gamma))
    raw = F.pow(F.sum("n").over(every) / (F.count(F.lit(1)).over(every) * F.col("n")), F.lit(power))
    table = c.select(y, "n", F.least(F.lit(largest), inverse).alias("inverse"), raw.alias("raw"))
    mean = F.sum(F.col("raw") * F.col("n")).over(every) / F.sum("n").over(every)
    return table.select(y, "n", "inverse", (F.col("raw") / mean).alias("balanced"))


def residualize(rows: DataFrame, segment: str, columns: list[str], weight: str, train: Column | None = None) -> DataFrame:
    """Columns less their weighted mean in the segment's training rows; segments without training rows stay as they are."""
    fit = rows if train is None else rows.where(train)
    w = F.col(weight)
    means = fit.groupBy(segment).agg(*[F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(f"__{c}") for c in columns])
    joined = rows.join(F.broadcast(means), segment, "left")  # a row a segment
    return joined.withColumns({c: F.col(c) - F.coalesce(f"__{c}", F.lit(0.0)) for c in columns}).drop(*[f"__{c}" for c in columns])


def merge_small_batches(rows: DataFrame, batch: str, least: int, manufacturer: str, field: str) -> DataFrame:
    """Batches of fewer than `least` rows are named manufacturer__field instead."""
    sizes = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("__n"))
    joined = rows.join(sizes, batch)
    other = F.concat_ws("__", F.trim(F.col(manufacturer).cast("string")), F.trim(F.col(field).cast("string")))
    return joined.withColumn(batch, F.when(F.col("__n") < least, other).otherwise(F.col(batch))).drop("__n")
