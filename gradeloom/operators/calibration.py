"""Calibration of probabilities and agreement of continuous outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reliability(rows: DataFrame, keys: list[str], confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """(keys, bin, n, confidence, accuracy) for the bins that have rows; a confidence of 1 is in the last bin."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def expected_error(table: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, ece) from a reliability table."""
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return table.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(gap).alias("gap")).select(*keys, "n", (F.col("gap") / F.col("n")).alias("ece"))


def top_confidence(p: Column) -> Column:
    return F.array_max(p)


def brier(rows: DataFrame, keys: list[str], p_cls: str = "p_cls", y: str = "y_true") -> DataFrame:
    """(keys, brier_top, brier_multi): of the likeliest class, and summed over classes."""
    p = F.col(p_cls)
    top = F.array_max(p)
    right = (F.array_position(p, top) == F.col(y)).cast("double")
    multi = F.aggregate(F.transform(p, lambda v, i: F.pow(v - (F.col(y) == i + 1).cast("double"), 2)), F.lit(0.0), lambda a, v: a + v)
    return rows.groupBy(*keys).agg(F.avg(F.pow(top - right, 2)).alias("brier_top"), F.avg(multi).alias("brier_multi"))


def one_against_rest(rows: DataFrame, keys: list[str], p: str, hit, bins: int = 10) -> DataFrame:
    """(keys, k, n, ece, brier) of each entry k (from 1) of an array of probabilities; hit(k) is a condition on the row."""
    long = rows.select(*keys, "y_true", F.posexplode(p).alias("i", "p")).withColumn("k", F.col("i") + 1)
    long = long.select(*keys, "k", "p", hit(F.col("k")).cast("double").alias("hit"))
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    table = long.groupBy(*keys, "k", b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("hit").alias("sh"), F.sum(F.pow(F.col("p") - F.col("hit"), 2)).alias("se")
    )
    return table.groupBy(*keys, "k").agg(F.sum("n").alias("n"), F.sum(F.abs(F.col("sp") - F.col("sh"))).alias("gap"), F.sum("se").alias("se")).select(*keys, "k", "n", (F.col("gap") / F.col("n")).alias("ece"), (F.col("se") / F.col("n")).alias("brier"))


def bland_altman(rows: DataFrame, x: str = "y_true", y: str = "y_cont", by: str | None = None) -> DataFrame:
    """(n, bias, sd, low, high, ccc) of y - x, of the rows or of the means by a key."""
    from .metrics import lin_ccc

    rows = rows.select(*([by] if by else []), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if by:
        rows = rows.groupBy(by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    rows = rows.withColumn("__all", F.lit(1))
    d = rows.groupBy("__all").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("y") - F.col("x")).alias("bias"), F.stddev_samp(F.col("y") - F.col("x")).alias("sd"))
    d = d.select("__all", "n", "bias", "sd", (F.col("bias") - 1.96 * F.col("sd")).alias("low"), (F.col("bias") + 1.96 * F.col("sd")).alias("high"))
    return d.join(lin_ccc(rows, ["__all"], "x", "y"), "__all").drop("__all")
