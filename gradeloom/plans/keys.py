"""Identifiers, reshaping, joins, cleaning and pooling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import cleaning, joins, reshape
from . import inputs
from .inputs import DISCS, FEATURES, STATISTICS
from .registry import query, r6


@query("SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey AS VARCHAR) AS again FROM customer")
def p01_norm_id(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer")
    dotted = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(".0 "))
    return c.select("c_custkey", keys.norm_id(dotted).alias("id"), keys.norm_id(F.col("c_custkey")).alias("again"))


_SAMPLES = "samples AS (SELECT (vec_id // 5) || '_' || (['L1-L2','L2-L3','L3-L4','L4-L5','L5-S1'])[CAST(vec_id % 5 AS INTEGER) + 1] AS sample_id FROM embeddings)"


def _samples(spark, sf_dir) -> DataFrame:
    e = inputs.table(spark, sf_dir, "embeddings")
    return e.select(F.concat_ws("_", F.floor(F.col("vec_id") / 5).cast("string"), F.lit(keys.SEGMENTS)[(F.col("vec_id") % 5).cast("int")]).alias("sample_id"))


@query(f"WITH {_SAMPLES} SELECT sample_id, split_part(sample_id, '_', 1) AS patient_id, split_part(sample_id, '_', 2) AS disc_level, CAST(list_position(['L3-L4','L4-L5','L5-S1'], split_part(sample_id, '_', 2)) - 1 AS INTEGER) AS task FROM samples WHERE split_part(sample_id, '_', 2) IN ('L3-L4','L4-L5','L5-S1')")
def p02_sample_parts(spark, sf_dir) -> DataFrame:
    levels = ["L3-L4", "L4-L5", "L5-S1"]
    rows = _samples(spark, sf_dir).withColumns({"patient_id": keys.patient_of(F.col("sample_id")), "disc_level": keys.level_of(F.col("sample_id"))})
    return reshape.only_levels(rows, "disc_level", levels).withColumn("task", keys.task_of(F.col("disc_level"), levels))


_PERTURBED = "pert AS (SELECT (vec_id // 5) || (['', '_dilation', '_erosion_image', '_dilation_trans_rot_mask', '_translation_image_mask'])[CAST(vec_id % 5 AS INTEGER) + 1] AS case_id FROM embeddings)"


@query(f"WITH {_PERTURBED} SELECT case_id, split_part(case_id, '_', 1) AS base_case_id, CASE WHEN instr(case_id, '_') = 0 THEN 'gold' ELSE regexp_replace(regexp_replace(substr(case_id, instr(case_id, '_') + 1), '_image$', ''), '_mask$', '') END AS condition FROM pert")
def p03_condition_of_case(spark, sf_dir) -> DataFrame:
    e = inputs.table(spark, sf_dir, "embeddings")
    names = F.lit(["", "_dilation", "_erosion_image", "_dilation_trans_rot_mask", "_translation_image_mask"])
    rows = e.select(F.concat(F.floor(F.col("vec_id") / 5).cast("string"), names[(F.col("vec_id") % 5).cast("int")]).alias("case_id"))
    return reshape.split_perturbed(rows)


def wide_features(spark, sf_dir) -> DataFrame:
    """A row per case, a column per segment and feature."""
    long = inputs.features(spark, sf_dir, ["gold"])
    named = long.withColumn("column", F.concat_ws("_", F.lit("Deep"), "segment", F.substring("feature", 6, 9)))
    columns = [f"Deep_{s}_{i}" for s in keys.SEGMENTS for i in range(64)]
    return named.groupBy("case_id").pivot("column", columns).agg(F.first("value"))


@query(f"WITH {FEATURES} SELECT case_id, segment, feature, {r6('value', 'value')} FROM feat WHERE condition = 'gold'")
def p04_wide_to_long(spark, sf_dir) -> DataFrame:
    return reshape.wide_to_long(wide_features(spark, sf_dir), ["case_id"], absent=False)  # a case may lack a level


@query(f"WITH {FEATURES} SELECT case_id AS Sample_ID, segment AS Disc_Level, " + ", ".join(r6(f"max(value) FILTER (feature = 'Deep_{i}')", f"Deep_{i}") for i in range(64)) + " FROM feat WHERE condition = 'gold' GROUP BY ALL")
def p04_export_by_level(spark, sf_dir) -> DataFrame:
    out = reshape.export_by_level(wide_features(spark, sf_dir), "case_id")
    return out.where(F.coalesce(*[F.col(f"Deep_{i}") for i in range(64)]).isNotNull())  # a case may lack a level


@query("SELECT CAST(o_orderkey AS VARCHAR) AS case_id, s.segment, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pfirrmann FROM orders, (VALUES ('L3-L4'), ('L4-L5'), ('L5-S1')) s(segment)")
def p05_wide_grades(spark, sf_dir) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders")
    y = F.substring("o_orderpriority", 1, 1).cast("int")
    roman = F.lit(list(keys.ROMAN))[y - 1]
    wide = o.select(F.col("o_orderkey").cast("string").alias("case_id"), y.cast("string").alias("L34"), roman.alias("L4-L5"), F.concat(y.cast("string"), F.lit(".0")).alias("grade L5S1"))
    long = reshape.grades_to_long(wide, "case_id", ["L3-L4", "L4-L5", "L5-S1"])
    return long.select("case_id", "segment", keys.grade_of(F.col("grade")).alias("pfirrmann"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 ELSE NULL END AS grade FROM customer")
def p06_grade_text(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer")
    return c.select("c_custkey", keys.grade_of(F.lit(["I", "2", " iii ", "4.0", "V", "none"])[(F.col("c_custkey") % 6).cast("int")]).alias("grade"))


@query("SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'classic' WHEN 'BUILDING' THEN 'pyradiomics' WHEN 'FURNITURE' THEN 'deep' WHEN 'HOUSEHOLD' THEN 'tensor' END AS family, count(*) AS n FROM customer GROUP BY ALL")
def p07_feature_family(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer")
    names = {"AUTOMOBILE": "classic_L3-L4_dhi", "BUILDING": "PyRadiomics_x", "FURNITURE": "Deep_1", "HOUSEHOLD": "Tucker_core_2"}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return c.groupBy(keys.family_of(F.coalesce(F.try_element_at(m, F.col("c_mktsegment")), F.lit("other_x"))).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEATURES} SELECT feature, count(*) AS n FROM feat WHERE condition = 'gold' AND feature IN ('Deep_0', 'Deep_1', 'Deep_7', 'Deep_9') GROUP BY feature")
def p08_forced_features(spark, sf_dir) -> DataFrame:
    long = inputs.features(spark, sf_dir, ["gold"])
    chosen = long.where(F.col("feature").isin("Deep_0", "Deep_1"))
    return reshape.forced_rows(chosen, long, keys.forced_names(["Deep_L3-L4_7", "Deep_9", "Deep_L4-L5_7", "Deep_1"])).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DISCS} SELECT patient_id, l_partkey, segment, " + ", ".join(f"CASE WHEN segment = {k} THEN 1.0::DOUBLE ELSE 0.0 END AS seg_{k}" for k in range(3)) + " FROM discs")
def p11_segment_one_hot(spark, sf_dir) -> DataFrame:
    return reshape.one_hot(inputs.discs(spark, sf_dir), "segment", [0, 1, 2]).select("patient_id", "l_partkey", "segment", "seg_0", "seg_1", "seg_2")


@query(f"WITH {STATISTICS} SELECT o_orderkey, " + ", ".join(f"CASE WHEN manufacturer = '{m}' THEN 1.0::DOUBLE ELSE 0.0 END AS manufacturer__{m}" for m in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM orders JOIN stats ON o_custkey = image_id")
def p12_case_one_hot(spark, sf_dir) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("image_id"))
    return reshape.one_hot_cases(o, inputs.statistics(spark, sf_dir), "image_id", "manufacturer", drop_first=True).drop("image_id")


_GRADES = "grades AS (SELECT CAST(o_orderkey AS VARCHAR) AS case_id, unnest(['" + "','".join(keys.SEGMENTS) + "']) AS segment, nullif(CAST(substr(o_orderpriority, 1, 1) AS INTEGER), 2) AS pfirrmann FROM orders)"


def _grades(spark, sf_dir) -> DataFrame:
    """A grade for every segment of an order; grade 2 is missing."""
    y = F.nullif(F.substring("o_orderpriority", 1, 1).cast("int"), F.lit(2))
    return inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), F.explode(F.lit(keys.SEGMENTS)).alias("segment"), y.alias("pfirrmann"))


@query(f"WITH {FEATURES}, {_GRADES} SELECT case_id, segment, count(*) AS n, CAST(sum(g.pfirrmann) AS BIGINT) AS total FROM feat JOIN grades g USING (case_id, segment) WHERE condition = 'gold' AND g.pfirrmann IS NOT NULL GROUP BY ALL")
def j01_attach_grade(spark, sf_dir) -> DataFrame:
    rows = inputs.features(spark, sf_dir, ["gold"]).drop("pfirrmann")
    return joins.attach_grade(rows, _grades(spark, sf_dir), missing="drop").groupBy("case_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("pfirrmann").alias("total"))


@query(f"WITH {FEATURES}, {_GRADES} SELECT case_id, segment, CAST(g.pfirrmann AS DOUBLE) AS pfirrmann FROM (SELECT DISTINCT case_id, segment FROM feat) JOIN grades g USING (case_id, segment) WHERE g.pfirrmann IS NOT NULL")
def j02_grade_series(spark, sf_dir) -> DataFrame:
    """Of the samples that have a grade, since the series of the others is an error."""
    grades = _grades(spark, sf_dir)
    index = inputs.features(spark, sf_dir).select("case_id", "segment").distinct()
    return joins.grade_series(joins.attach_grade(index, grades, missing="drop").drop("pfirrmann"), grades)


@query(f"WITH {STATISTICS} SELECT manufacturer, field_strength, count(*) AS n FROM orders LEFT JOIN stats ON o_custkey = image_id GROUP BY ALL")
def j03_attach_case(spark, sf_dir) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"))
    return joins.attach_case(o, inputs.statistics(spark, sf_dir), "image_id").groupBy("manufacturer", "field_strength").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {FEATURES} SELECT case_id, segment, count(*) AS n FROM feat WHERE case_id NOT IN ('3', '7') AND feature <> 'Deep_5' GROUP BY ALL")
def j04_align_conditions(spark, sf_dir) -> DataFrame:
    long = inputs.features(spark, sf_dir)
    holes = (F.col("case_id").isin("3", "7") & (F.col("condition") == "erosion")) | ((F.col("feature") == "Deep_5") & (F.col("condition") == "dilation"))
    return cleaning.align(long.where(~holes), 4).groupBy("case_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def j05_only_patients(spark, sf_dir) -> DataFrame:
    o = inputs.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = inputs.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return joins.only_patients(o, c, "o_custkey")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ORDER BY 1 LIMIT 10")
def j06_uncovered(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer").where(F.col("c_mktsegment") != "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return joins.uncovered(inputs.table(spark, sf_dir, "orders"), c, "o_custkey")


@query(f"WITH a AS (SELECT c_custkey AS case_id, c_acctbal AS v, c_nationkey AS w FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS case_id, -c_acctbal AS v, c_mktsegment AS m FROM customer WHERE c_custkey % 3 <> 1) SELECT coalesce(a.case_id, b.case_id) AS case_id, {r6('coalesce(b.v, a.v)', 'v')}, w, m FROM a FULL JOIN b ON a.case_id = b.case_id")
def j07_merge_features(spark, sf_dir) -> DataFrame:
    c = inputs.table(spark, sf_dir, "customer")
    a = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("case_id"), F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("w"))
    b = c.where("c_custkey % 3 <> 1").select(F.col("c_custkey").alias("case_id"), (-F.col("c_acctbal")).alias("v"), F.col("c_mktsegment").alias("m"))
    return joins.merge_features(a, b)


_ROW = "(l_partkey * 100000 + l_suppkey) * 100000 + l_linenumber * 10000 + CAST(l_quantity AS BIGINT) * 100 + CAST(round(l_tax * 100) AS BIGINT)"


@query(f"SELECT l_orderkey, {r6(f'arg_min(l_quantity, {_ROW}) FILTER (l_discount > 0.02)', 'q')}, {r6(f'arg_min(l_tax, {_ROW}) FILTER (l_tax > 0)', 't')} FROM lineitem GROUP BY l_orderkey")
def c01_first_values(spark, sf_dir) -> DataFrame:
    li = inputs.table(spark, sf_dir, "lineitem")
    rows = li.select("l_orderkey", F.expr(_ROW).alias("row"), F.when(F.col("l_discount") > 0.02, F.col("l_quantity")).alias("q"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("t"))
    return cleaning.first_values(rows, ["l_orderkey"], "row", ["q", "t"])


@query(f"WITH {FEATURES}, h AS (SELECT * REPLACE (CASE WHEN feature IN ('Deep_3', 'Deep_4') AND case_id = '2' AND condition = 'erosion' THEN NULL WHEN feature = 'Deep_9' THEN 1.0 ELSE value END AS value) FROM feat), a AS (SELECT feature FROM h GROUP BY feature HAVING count(*) = count(value)), b AS (SELECT feature FROM h WHERE condition = 'gold' GROUP BY feature HAVING var_samp(value) > 1e-12) SELECT feature, count(*) AS n, {r6('sum(value)', 'total')} FROM h WHERE feature IN (SELECT * FROM a) AND feature IN (SELECT * FROM b) GROUP BY feature")
def c02_c03_clean_features(spark, sf_dir) -> DataFrame:
    f = F.col("feature")
    hole = f.isin("Deep_3", "Deep_4") & (F.col("case_id") == "2") & (F.col("condition") == "erosion")
    long = inputs.features(spark, sf_dir).withColumn("value", F.when(hole, None).when(f == "Deep_9", 1.0).otherwise(F.col("value")))
    return cleaning.drop_constant(cleaning.drop_incomplete(long)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _holes(spark, sf_dir) -> DataFrame:
    li = inputs.table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_linenumber") == 2, None).otherwise(F.col("l_quantity"))
    price = F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_extendedprice"))
    both = F.array(F.struct(F.lit("q").alias("feature"), value.alias("value")), F.struct(F.lit("p").alias("feature"), price.alias("value")))
    return li.select("l_orderkey", "l_partkey", (F.col("l_orderkey") % 5).alias("fold"), F.explode(both).alias("e")).select("l_orderkey", "l_partkey", "fold", "e.*")


_HOLES = "holes AS (SELECT l_orderkey, l_partkey, l_orderkey % 5 AS fold, 'q' AS feature, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_quantity END AS value FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_orderkey % 5, 'p', CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice END FROM lineitem)"


@query(f"WITH {_HOLES}, m AS (SELECT feature, median(value) AS m FROM holes GROUP BY feature) SELECT fold, feature, count(value) AS n_known, {r6('sum(coalesce(value, m))', 'total')} FROM holes JOIN m USING (feature) GROUP BY ALL")
def c04_median_imputation(spark, sf_dir) -> DataFrame:
    rows = _holes(spark, sf_dir)
    known = rows.withColumn("known", F.col("value").isNotNull())
    return cleaning.impute(known, cleaning.medians(rows)).groupBy("fold", "feature").agg(F.count_if("known").alias("n_known"), F.sum("value").alias("total"))


@query(f"WITH {_HOLES}, m AS (SELECT feature, median(value) AS m FROM holes WHERE fold <> 0 GROUP BY feature) SELECT fold, feature, {r6('sum(coalesce(value, m))', 'total')} FROM holes JOIN m USING (feature) GROUP BY ALL")
def c05_fold_imputation(spark, sf_dir) -> DataFrame:
    rows = _holes(spark, sf_dir)
    return cleaning.impute(rows, cleaning.medians(rows, F.col("fold") != 0)).groupBy("fold", "feature").agg(F.sum("value").alias("total"))


_PAIRS = "pairs AS (SELECT * FROM discs QUALIFY count(*) OVER (PARTITION BY patient_id) >= 2)"
_POOL = ", ".join(r6(e.format(c=c), f"pool_classic_{s}__{c}") for s, e in (("mean", "avg({c}) OVER w"), ("delta", "{c} - avg({c}) OVER w"), ("mean_minus_d", "(count(*) OVER w * avg({c}) OVER w - {c}) / (count(*) OVER w - 1)")) for c in ("l_quantity", "l_tax"))


@query(f"WITH {DISCS}, {_PAIRS} SELECT patient_id, l_partkey, l_suppkey, {_POOL} FROM pairs WINDOW w AS (PARTITION BY patient_id)")
def c06_patient_pooling(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    rows = inputs.discs(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("patient_id"))).where("n >= 2")
    out = cleaning.pool(rows, "patient_id", ["l_quantity", "l_tax"], ["mean", "delta", "mean-d"], "classic")
    return out.select("patient_id", "l_partkey", "l_suppkey", *[c for c in out.columns if c.startswith("pool_")])


@query(f"WITH {DISCS} SELECT patient_id, l_partkey, {r6('1.0 / count(*) OVER (PARTITION BY patient_id)', 'weight')} FROM discs")
def c08_patient_weights(spark, sf_dir) -> DataFrame:
    return cleaning.patient_weights(inputs.discs(spark, sf_dir), "patient_id").select("patient_id", "l_partkey", "weight")


@query(f"WITH c AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y_true, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT *, least(10.0, power(max(n) OVER () / CAST(n AS DOUBLE), 0.5)) AS inverse, sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE) AS raw FROM c) SELECT y_true, n, {r6('inverse', 'inverse')}, {r6('raw / (sum(raw * n) OVER () / sum(n) OVER ())', 'balanced')} FROM d")
def c09_class_weights(spark, sf_dir) -> DataFrame:
    return cleaning.class_weights(inputs.predictions(spark, sf_dir), "y_true", gamma=0.5)


@query(f"WITH {DISCS}, w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY patient_id) AS weight FROM discs), m AS (SELECT segment, sum(weight * l_quantity) / sum(weight) AS q, sum(weight * l_tax) / sum(weight) AS t FROM w WHERE patient_id % 5 <> 0 GROUP BY segment) SELECT patient_id, l_partkey, l_suppkey, {r6('l_quantity - q', 'l_quantity')}, {r6('l_tax - t', 'l_tax')} FROM w JOIN m USING (segment)")
def c10_segment_residuals(spark, sf_dir) -> DataFrame:
    rows = cleaning.patient_weights(inputs.discs(spark, sf_dir), "patient_id")
    out = cleaning.residualize(rows, "segment", ["l_quantity", "l_tax"], "weight", F.col("patient_id") % 5 != 0)
    return out.select("patient_id", "l_partkey", "l_suppkey", "l_quantity", "l_tax")


@query(f"WITH {STATISTICS}, b AS (SELECT *, manufacturer || '__' || model || '__' || CAST(field_strength AS VARCHAR) AS batch FROM stats) SELECT image_id, CASE WHEN count(*) OVER (PARTITION BY batch) < 8 THEN manufacturer || '__' || CAST(field_strength AS VARCHAR) ELSE batch END AS batch FROM b")
def c11_small_batches(spark, sf_dir) -> DataFrame:
    rows = inputs.statistics(spark, sf_dir)
    rows = rows.withColumn("field_strength", F.col("field_strength").cast("string")).withColumn("batch", F.concat_ws("__", "manufacturer", "model", "field_strength"))
    return cleaning.merge_small_batches(rows, "batch", 8, "manufacturer", "field_strength").select("image_id", "batch")
