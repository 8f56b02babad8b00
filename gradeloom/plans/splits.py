"""Grouped cross-validation splits and their balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import splits
from . import inputs
from .inputs import CLASSES, PREDICTIONS
from .registry import query, r6


def _patients(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir).select("patient_id", "y_true", "task")
    s = inputs.statistics(spark, sf_dir).select(F.col("image_id").alias("patient_id"), F.col("manufacturer").alias("scanner"))
    return rows.join(s, "patient_id")


def _loads(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Groups and rows of each fold."""
    sizes = rows.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(sizes, "patient_id").groupBy("fold").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"))


@query()
def v01_group_kfold(spark, sf_dir) -> DataFrame:
    return splits.group_kfold(inputs.predictions(spark, sf_dir), "patient_id", 5)


@query("SELECT count(DISTINCT o_custkey) AS groups, count(*) AS rows, TRUE AS even FROM orders")
def v01_group_kfold_covers(spark, sf_dir) -> DataFrame:
    """Every group is in one fold, and the folds' rows differ by no more than a group."""
    rows = inputs.predictions(spark, sf_dir)
    loads = _loads(rows, splits.group_kfold(rows, "patient_id", 5))
    largest = rows.groupBy("patient_id").count().agg(F.max("count")).first()[0]
    return loads.agg(F.sum("groups").alias("groups"), F.sum("rows").alias("rows"), (F.max("rows") - F.min("rows") <= F.lit(largest)).alias("even"))


@query("SELECT count(DISTINCT o_custkey) AS groups, count(*) AS rows FROM orders")
def v03_stratified_covers(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    return _loads(rows, splits.stratified_group_kfold(rows, "patient_id", "y_true", CLASSES, 5)).agg(F.sum("groups").alias("groups"), F.sum("rows").alias("rows"))


@query()
def v03_stratified_group_kfold(spark, sf_dir) -> DataFrame:
    return splits.stratified_group_kfold(inputs.predictions(spark, sf_dir), "patient_id", "y_true", CLASSES, 5)


@query()
def v04_balanced_split(spark, sf_dir) -> DataFrame:
    return splits.balanced_split(_patients(spark, sf_dir), "patient_id", "y_true", "scanner", CLASSES, 5)


@query(f"""WITH {PREDICTIONS}, f AS (SELECT DISTINCT fold FROM pred), v AS (SELECT y_true, count(*) AS a FROM pred GROUP BY 1), d AS (SELECT f.fold, v.y_true, v.a, count(p.fold) AS n_val FROM f CROSS JOIN v LEFT JOIN pred p ON p.fold = f.fold AND p.y_true = v.y_true GROUP BY ALL),
t AS (SELECT fold, y_true, n_val, a - n_val AS n_train, 100.0 * n_val / sum(n_val) OVER (PARTITION BY fold) AS pv, 100.0 * (a - n_val) / sum(a - n_val) OVER (PARTITION BY fold) AS pt FROM d)
SELECT fold, y_true, n_val, n_train, {r6('pv', 'pct_val')}, {r6('pt', 'pct_train')}, {r6('pv - pt', 'pct_diff')}, {r6('max(abs(pv - pt)) OVER (PARTITION BY fold)', 'max_abs_diff')} FROM t""")
def v05_balance_report(spark, sf_dir) -> DataFrame:
    return splits.balance_report(inputs.predictions(spark, sf_dir), "y_true")


_SCANNER = f"""{PREDICTIONS}, {inputs.STATISTICS}, pt AS (SELECT DISTINCT patient_id, fold, manufacturer AS scanner FROM pred JOIN stats ON patient_id = image_id),
f AS (SELECT DISTINCT fold FROM pt), v AS (SELECT scanner, count(*) AS a FROM pt GROUP BY 1), d AS (SELECT f.fold, v.scanner, v.a, count(pt.fold) AS n_val FROM f JOIN v ON TRUE LEFT JOIN pt ON pt.fold = f.fold AND pt.scanner = v.scanner GROUP BY ALL),
t AS (SELECT fold, scanner, n_val, a - n_val AS n_train, 100.0 * n_val / sum(n_val) OVER (PARTITION BY fold) AS pv, 100.0 * (a - n_val) / sum(a - n_val) OVER (PARTITION BY fold) AS pt FROM d)"""


@query(f"WITH {_SCANNER} SELECT fold, scanner, n_val, n_train, {r6('pv', 'pct_val')}, {r6('pt', 'pct_train')}, {r6('pv - pt', 'pct_diff')}, {r6('max(abs(pv - pt)) OVER (PARTITION BY fold)', 'max_abs_diff')} FROM t")
def v05_patient_report(spark, sf_dir) -> DataFrame:
    """Balance of scanners over patients, each counted once."""
    folds = inputs.predictions(spark, sf_dir).select("patient_id", "fold").distinct()
    scanners = inputs.statistics(spark, sf_dir).select(F.col("image_id").alias("patient_id"), F.col("manufacturer").alias("scanner"))
    return splits.balance_report(folds.join(scanners, "patient_id"), "scanner")


@query()
def v06_nested_split(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    outer = rows.select("patient_id", "fold").distinct()
    return splits.nested_split(rows, "patient_id", outer, 3)
