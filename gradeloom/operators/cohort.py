"""Cohort and scanner reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grade_distribution(rows: DataFrame, segment: str, grade: str, classes: int) -> DataFrame:
    """(segment, grade, n): by segment and, as segment "all", overall; every grade of 1..K has a row."""
    counts = rows.where(F.col(grade).between(1, classes)).cube(segment, grade).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    named = counts.where(F.col("g").isin(0, 2)).select(F.when(F.col("g") == 2, F.lit("all")).otherwise(F.col(segment).cast("string")).alias("segment"), F.col(grade).cast("int").alias("grade"), "n")
    one = named.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("grade", "n"))).alias("by"))
    return one.select("segment", "by", F.explode(F.sequence(F.lit(1), F.lit(classes))).alias("grade")).select("segment", "grade", F.coalesce(F.element_at("by", F.col("grade")), F.lit(0)).alias("n"))


def top_and_other(rows: DataFrame, value: str, n: int) -> DataFrame:
    """(value, n): the n most frequent values (ties by value) and "Other" for the rest."""
    counts = rows.groupBy(F.col(value).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "value").limit(n).select(F.col("value").alias("__top"), F.lit(True).alias("__in"))
    joined = counts.join(F.broadcast(top), F.col("value").eqNullSafe(F.col("__top")), "left")  # n rows
    return joined.groupBy(F.when(F.col("__in"), F.col("value")).otherwise("Other").alias("value")).agg(F.sum("n").alias("n"))


def image_counts(stats: DataFrame, image: str, keys: list[str]) -> DataFrame:
    """(key, value, n): distinct images by each of the columns, in one pass."""
    long = stats.select(image, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e"))
    return long.groupBy("e.key", "e.value").agg(F.count_distinct(image).alias("n"))


def series_rollup(headers: DataFrame, case: Column, patterns: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """One series per case: instances seen by (study, series), those whose description or protocol contains a pattern, the largest (ties by series)."""
    pattern = "(?i)" + "|".join(re.escape(p) for p in patterns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = headers.where(text("series_description").rlike(pattern) | text("protocol_name").rlike(pattern)).withColumn("case_no", case)
    if low is not None:
        rows = rows.where(F.col("case_no") >= low)
    if high is not None:
        rows = rows.where(F.col("case_no") <= high)
    seen = rows.groupBy("case_no", "study_instance_uid", "series_instance_uid").agg(F.count(F.lit(1)).alias("n_instances"), F.min("series_description").alias("series_description"))
    rank = F.row_number().over(Window.partitionBy("case_no").orderBy(F.desc("n_instances"), "study_instance_uid", "series_instance_uid"))
    return seen.withColumn("r", rank).where("r = 1").drop("r")


def batch_statistics(rows: DataFrame, status: str, features: list[str]) -> DataFrame:
    """(status, n, and per feature mean and sd)."""
    agg = [F.count(F.lit(1)).alias("n")]
    for f in features:
        agg += [F.avg(f).alias(f"{f}_mean"), F.stddev_pop(f).alias(f"{f}_sd")]
    return rows.groupBy(status).agg(*agg)


def family_counts(columns: list[str]) -> dict[str, int]:
    """Number of feature columns by family."""
    from ..functions.keys import FAMILIES

    out: dict[str, int] = {}
    for c in columns:
        family = FAMILIES.get(c.split("_")[0].lower(), "other")
        out[family] = out.get(family, 0) + 1
    return out


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()).strip("_")


def batch_key(*parts: Column) -> Column:
    """Parts joined by "__", line ends as blanks, trimmed."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " "))
    return F.concat_ws("__", *[clean(p) for p in parts])


def unite_cohorts(first: DataFrame, second: DataFrame, images: DataFrame, columns: list[str], offset: int = 0, suffix: str | None = None) -> DataFrame:
    """Both cohorts in one schema: names to snake case, the second's ids moved by `offset`, only rows with an available image (image_id), a batch key, fixed columns with '' where a cohort has none.

    With `suffix`, only rows of the second whose source case ends with it.
    """
    a = first.withColumnsRenamed({c: snake(c) for c in first.columns})
    b = second.withColumnsRenamed({c: snake(c) for c in second.columns})
    if suffix:
        b = b.where(F.col("source_case").endswith(suffix))
    b = b.withColumn("image_id", F.col("image_id") + offset)
    both = a.unionByName(b, allowMissingColumns=True).join(images.select("image_id"), "image_id", "left_semi")
    both = both.withColumn("batch_scanner", batch_key(F.col("manufacturer"), F.col("model"), F.col("field_strength")))
    return both.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in both.columns else F.lit("").alias(c) for c in columns])
