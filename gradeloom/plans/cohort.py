"""Cohort and scanner reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort
from . import inputs
from .inputs import PREDICTIONS, STATISTICS
from .registry import query, r6


@query(f"WITH {PREDICTIONS}, s AS (SELECT CAST(task AS VARCHAR) AS segment, y_true FROM pred UNION ALL SELECT 'all', y_true FROM pred), d AS (SELECT DISTINCT segment FROM s) SELECT segment, CAST(k AS INTEGER) AS grade, count(y_true) AS n FROM d CROSS JOIN (SELECT unnest(range(1, 6)) AS k) LEFT JOIN s USING (segment) WHERE y_true = k OR y_true IS NULL GROUP BY segment, k")
def r01_grade_distribution(spark, sf_dir) -> DataFrame:
    return cohort.grade_distribution(inputs.predictions(spark, sf_dir), "task", "y_true", 5)


@query(f"WITH {STATISTICS}, c AS (SELECT model AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, model) AS r FROM stats GROUP BY model) SELECT CASE WHEN r <= 5 THEN value ELSE 'Other' END AS value, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def r02_top_and_other(spark, sf_dir) -> DataFrame:
    return cohort.top_and_other(inputs.statistics(spark, sf_dir), "model", 5)


@query(f"WITH {STATISTICS} SELECT 'manufacturer' AS key, manufacturer AS value, count(DISTINCT image_id) AS n FROM stats GROUP BY 2 UNION ALL SELECT 'model', model, count(DISTINCT image_id) FROM stats GROUP BY 2")
def r03_image_counts(spark, sf_dir) -> DataFrame:
    return cohort.image_counts(inputs.statistics(spark, sf_dir), "image_id", ["manufacturer", "model"])


@query("WITH s AS (SELECT user_id AS case_no, event_type, count(*) AS n_instances FROM events WHERE (event_type ILIKE '%CLI%' OR event_type ILIKE '%view%') AND user_id BETWEEN 1 AND 100000 GROUP BY ALL) SELECT case_no, CAST(case_no AS VARCHAR) AS study_instance_uid, event_type AS series_instance_uid, n_instances, event_type AS series_description FROM s QUALIFY row_number() OVER (PARTITION BY case_no ORDER BY n_instances DESC, event_type) = 1")
def r04_series_rollup(spark, sf_dir) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events")
    headers = e.select("user_id", F.col("user_id").cast("string").alias("study_instance_uid"), F.col("event_type").alias("series_instance_uid"), F.col("event_type").alias("series_description"), F.lit(None).cast("string").alias("protocol_name"))
    return cohort.series_rollup(headers, F.col("user_id"), ["CLI", "view"], 1, 100000)


@query(f"SELECT l_returnflag, count(*) AS n, {r6('avg(l_quantity)', 'l_quantity_mean')}, {r6('stddev_pop(l_quantity)', 'l_quantity_sd')}, {r6('avg(l_tax)', 'l_tax_mean')}, {r6('stddev_pop(l_tax)', 'l_tax_sd')} FROM lineitem GROUP BY l_returnflag")
def r05_batch_statistics(spark, sf_dir) -> DataFrame:
    return cohort.batch_statistics(inputs.table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_quantity", "l_tax"])


@query(f"""WITH {STATISTICS}, a AS (SELECT image_id, manufacturer, model, CAST(field_strength AS VARCHAR) AS f, '' AS note FROM stats WHERE image_id % 2 = 0 UNION ALL SELECT image_id + 1000000, manufacturer, model, CAST(field_strength AS VARCHAR), 'late' FROM stats WHERE image_id % 2 = 1)
SELECT CAST(image_id AS VARCHAR) AS image_id, manufacturer, model, note, manufacturer || '__' || model || '__' || f AS batch_scanner, '' AS station FROM a WHERE CASE WHEN image_id > 1000000 THEN image_id - 1000000 ELSE image_id END IN (SELECT o_custkey FROM orders)""")
def r06_unite_cohorts(spark, sf_dir) -> DataFrame:
    s = inputs.statistics(spark, sf_dir)
    first = s.where("image_id % 2 = 0").withColumnsRenamed({"image_id": "imageId", "field_strength": "Field Strength"}).drop("balance")
    second = s.where("image_id % 2 = 1").drop("balance").withColumn("note", F.lit("late")).withColumn("source_case", F.lit("x_t2"))
    there = inputs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"))  # images that are at hand
    ids = there.union(there.select(F.col("image_id") + 1000000)).distinct()
    return cohort.unite_cohorts(first, second, ids, ["image_id", "manufacturer", "model", "note", "batch_scanner", "station"], offset=1000000, suffix="_t2")
