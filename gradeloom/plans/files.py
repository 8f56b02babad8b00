"""Readers and writers: tables written to files and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import metrics, reshape, selection
from ..sources import tables
from . import inputs
from . import keys as _keys  # noqa: F401  its SQL holds for the files too
from . import selection as _selection  # noqa: F401
from .inputs import PREDICTIONS, STATISTICS
from .registry import ORACLES, query, r6


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; only without spark.checkpoint.dir one on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/gradeloom-files-{uuid.uuid4().hex}"


def _csv(rows: DataFrame) -> str:
    path = _folder(rows.sparkSession)
    rows.write.option("header", True).csv(path)
    return path


@query(ORACLES["p04_wide_to_long"])
def s01_read_features(spark, sf_dir) -> DataFrame:
    return reshape.wide_to_long(tables.read_features(spark, _csv(_keys.wide_features(spark, sf_dir))), ["case_id"]).where(F.col("value").isNotNull())


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y, {r6('o_totalprice', 'f_price')}, {r6('CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END', 'f_cust')} FROM orders")
def s02_read_model_input(spark, sf_dir) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    cust = F.when(F.col("o_orderkey") % 7 == 0, "missing").otherwise(F.col("o_custkey").cast("string"))
    rows = o.select(F.col("o_orderkey").alias(" sample_id"), F.substring("o_orderpriority", 1, 1).alias("y "), cust.alias("f_cust"), F.col("o_totalprice").alias("f_price"), F.lit("z").alias("note"))
    return tables.read_model_input(spark, _csv(rows), "sample_id", "y", keep_regex="^f_", order="sorted")


@query(ORACLES["p05_wide_grades"])
def s03_read_grades(spark, sf_dir) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    y = F.substring("o_orderpriority", 1, 1).cast("int")
    wide = o.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("ID"), y.cast("string").alias("l34"), F.lit(list(keys.ROMAN))[y - 1].alias("l4-L5"), y.cast("string").alias("grade L5S1"))
    return tables.read_grades(spark, _csv(wide), ["L3-L4", "L4-L5", "L5-S1"])


@query(f"WITH {STATISTICS} SELECT CAST(image_id AS VARCHAR) AS image_id, manufacturer, {r6('field_strength', 'spacing_x')} FROM stats")
def s04_read_statistics(spark, sf_dir) -> DataFrame:
    s = inputs.statistics(spark, sf_dir)
    text = s.select(F.concat(F.col("image_id").cast("string"), F.lit(".0")).alias("image_id"), "manufacturer", F.concat(F.lit("["), F.col("field_strength").cast("string"), F.lit(", 1.0]")).alias("pixel_spacing"), F.lit(0).alias("row"))
    again = text.withColumn("manufacturer", F.lit("later")).withColumn("row", F.lit(1))
    rows = tables.read_statistics(spark, _csv(text.unionByName(again)), order_col="row")
    return rows.select("image_id", "manufacturer", F.col("spacing")[0].alias("spacing_x"))


@query(f"WITH {PREDICTIONS} SELECT fold, count(*) AS n, CAST(sum(y_pred) AS BIGINT) AS total FROM pred GROUP BY fold")
def s05_read_predictions(spark, sf_dir) -> DataFrame:
    rows, path = inputs.predictions(spark, sf_dir).select("orig_index", "fold", "y_true", "y_pred"), _folder(spark)
    for k in range(5):
        rows.where(F.col("fold") == k).drop("fold").write.option("header", True).csv(f"{path}/fold_{k}/val_predictions.csv")
    return tables.read_predictions(spark, f"{path}/fold_*/val_predictions.csv").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y_pred").cast("long").alias("total"))


@query(ORACLES["f01_icc"])
def s06_write_tables(spark, sf_dir) -> DataFrame:
    path = _folder(spark)
    tables.write_tables({"icc": selection.icc21(inputs.features(spark, sf_dir), 0.9)}, path)
    return spark.read.parquet(f"{path}/icc")


@query(f"WITH {PREDICTIONS}, f AS (SELECT CAST(fold AS VARCHAR) AS fold, avg(abs(y_true - y_pred)) AS mae FROM pred GROUP BY fold) SELECT fold, {r6('mae', 'mae')} FROM f UNION ALL SELECT 'fold_mean', {r6('avg(mae)', 'mae')} FROM f UNION ALL SELECT 'mean', {r6('avg(abs(y_true - y_pred))', 'mae')} FROM pred")
def s07_write_summary(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir)
    by_fold = metrics.count_metrics(rows, ["fold"], inputs.CLASSES).select("fold", "mae")
    path = _folder(spark)
    tables.write_summary(by_fold, metrics.count_metrics(rows, [], inputs.CLASSES).select("mae"), None, path)
    return spark.read.option("header", True).csv(path).select("fold", F.col("mae").cast("double").alias("mae"))


@query(f"WITH {PREDICTIONS} SELECT task, {r6('avg(y_cont)', 'mean')}, count(*) AS n, CAST(min(y_pred) AS BIGINT) AS low FROM pred GROUP BY task")
def s07_write_json(spark, sf_dir) -> DataFrame:
    rows = inputs.predictions(spark, sf_dir).groupBy("task").agg(F.avg("y_cont").alias("mean"), F.count(F.lit(1)).alias("n"), F.min("y_pred").cast("long").alias("low"))
    path = _folder(spark)
    tables.write_json({"by_task": rows}, path)
    return spark.read.schema(rows.schema).json(f"{path}/by_task")


@query("SELECT 'img/' || c_custkey AS key, 'img/' || c_custkey || '.nii.gz' AS image, 'img/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '_mask.nii' ELSE '-seg.nii.gz' END AS mask FROM customer WHERE c_custkey % 2 = 0")
def s09_pair_images(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer")
    name = F.concat(F.lit("img/"), F.col("c_custkey").cast("string"))
    images = c.select(F.concat(name, F.lit(".nii.gz")).alias("path"))
    masks = c.where("c_custkey % 2 = 0").select(F.concat(name, F.when(F.col("c_custkey") % 3 == 0, "_mask.nii").otherwise("-seg.nii.gz")).alias("path"))
    return tables.pair_images(images, masks)
