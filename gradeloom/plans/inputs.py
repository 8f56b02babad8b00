"""The given tables as the jobs' inputs, in Spark and in SQL (common table expressions of the same name)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coral, keys

CLASSES = 5
THETA = [-1.5, -0.5, 0.5, 1.5]
CONDITIONS = ["gold", "dilation", "erosion", "translation"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def predictions(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    y = F.substring("o_orderpriority", 1, 1).cast("int")
    noise = F.pmod(F.col("o_orderkey") * F.lit(2654435761), F.lit(1000)) / 1000.0 - 0.5
    rows = o.select(
        F.col("o_orderkey").alias("orig_index"), F.col("o_custkey").alias("patient_id"), (F.col("o_orderkey") % 3).cast("int").alias("task"), (F.col("o_custkey") % 5).cast("int").alias("fold"), y.alias("y_true"), (y - 3 + 2 * noise * 1.8).alias("s")
    )
    p = coral.bounds(F.col("s"), THETA)  # the score itself, s, stays for what works on log odds
    return rows.withColumns({"p_gt": F.array(*p), "y_cont": coral.expected(p), "y_pred": coral.decode(p), "p_cls": coral.class_probabilities(p)})


_P = ", ".join(f"1.0/(1.0+exp(-(s - ({t})))) AS p{k}" for k, t in enumerate(THETA, 1))
PREDICTIONS = f"""pred0 AS (
  SELECT o_orderkey AS orig_index, o_custkey AS patient_id, CAST(o_orderkey % 3 AS INTEGER) AS task, CAST(o_custkey % 5 AS INTEGER) AS fold,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS y_true,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 3 + 2 * ((((o_orderkey * 2654435761) % 1000) / CAST(1000.0 AS DOUBLE)) - CAST(0.5 AS DOUBLE)) * CAST(1.8 AS DOUBLE) AS s
  FROM orders),
pred1 AS (SELECT *, {_P} FROM pred0),
pred AS (SELECT *, 1.0 + p1 + p2 + p3 + p4 AS y_cont,
    1 + CAST(p1 > 0.5 AS INTEGER) + CAST(p2 > 0.5 AS INTEGER) + CAST(p3 > 0.5 AS INTEGER) + CAST(p4 > 0.5 AS INTEGER) AS y_pred,
    1.0 - p1 AS c1, p1 - p2 AS c2, p2 - p3 AS c3, p3 - p4 AS c4, p4 AS c5 FROM pred1)"""


def features(spark, sf_dir, conditions: list[str] = CONDITIONS) -> DataFrame:
    """feature_long: a value per case, segment, condition and feature, with the grade."""
    e = table(spark, sf_dir, "embeddings")
    base = e.select("vec_id", F.floor(F.col("vec_id") / 5).cast("string").alias("case_id"), F.lit(keys.SEGMENTS)[(F.col("vec_id") % 5).cast("int")].alias("segment"), (F.lit(1) + F.col("label") % 5).cast("int").alias("pfirrmann"), F.posexplode("embedding").alias("pos", "v"))
    v = F.col("v").cast("double")
    out = None
    for c in conditions:
        k = CONDITIONS.index(c)
        value = v if k == 0 else v * F.lit(1 + 0.01 * k) + F.lit(0.02) * (F.pmod(F.col("vec_id") * 7 + F.col("pos") * 3 + k, F.lit(5)) - 2) * (F.col("pos") % 4)
        part = base.select("case_id", "segment", "pfirrmann", F.lit(c).alias("condition"), F.concat(F.lit("Deep_"), F.col("pos").cast("string")).alias("feature"), value.alias("value"))
        out = part if out is None else out.union(part)
    return out


_SEG = "['" + "','".join(keys.SEGMENTS) + "']"
_BASE = f"""emb AS (SELECT vec_id, CAST(vec_id // 5 AS VARCHAR) AS case_id, ({_SEG})[CAST(vec_id % 5 AS INTEGER) + 1] AS segment, CAST(1 + label % 5 AS INTEGER) AS pfirrmann,
  CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""
FEATURES = (
    _BASE
    + ",\nfeat AS ("
    + " UNION ALL ".join(
        f"SELECT case_id, segment, pfirrmann, '{c}' AS condition, 'Deep_' || pos AS feature, "
        + ("v" if k == 0 else f"v * CAST({1 + 0.01 * k!r} AS DOUBLE) + CAST(0.02 AS DOUBLE) * ((vec_id * 7 + pos * 3 + {k}) % 5 - 2) * (pos % 4)")
        + " AS value FROM emb"
        for k, c in enumerate(CONDITIONS)
    )
    + ")"
)


def planted(spark, sf_dir) -> DataFrame:
    """Gold features with a monotone relation to the grade in the first eight."""
    f = features(spark, sf_dir, ["gold"])
    pos = F.substring_index("feature", "_", -1).cast("int")
    return f.withColumn("value", F.when(pos < 8, F.col("value") + 0.05 * F.col("pfirrmann")).otherwise(F.col("value")))


PLANTED = _BASE + """,
planted AS (SELECT case_id, segment, pfirrmann, 'gold' AS condition, 'Deep_' || pos AS feature,
  CASE WHEN pos < 8 THEN v + CAST(0.05 AS DOUBLE) * pfirrmann ELSE v END AS value FROM emb)"""


def discs(spark, sf_dir) -> DataFrame:
    """Discs of patients with four features, a batch and a segment."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation")
    rows = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    return rows.select(
        F.col("l_orderkey").alias("patient_id"), (F.col("l_linenumber") % 3).cast("int").alias("segment"), F.col("n_name").alias("batch"), F.col("n_regionkey").alias("region"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )


DISCS = """discs AS (SELECT l_orderkey AS patient_id, CAST(l_linenumber % 3 AS INTEGER) AS segment, n_name AS batch, n_regionkey AS region, l_partkey, l_suppkey, l_linenumber,
  l_quantity, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
DISC_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def statistics(spark, sf_dir) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("image_id"), F.col("c_mktsegment").alias("manufacturer"), F.col("n_name").alias("model"), (1.5 + 1.5 * (F.col("c_custkey") % 2)).alias("field_strength"), F.col("c_acctbal").alias("balance")
    )


STATISTICS = """stats AS (SELECT c_custkey AS image_id, c_mktsegment AS manufacturer, n_name AS model, 1.5 + 1.5 * (c_custkey % 2) AS field_strength, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def contributions(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("pos", "v"))
    x = F.col("v").cast("double")
    return e.select(F.col("vec_id").alias("sample_id"), (F.col("vec_id") % 5).cast("int").alias("fold"), (F.col("label") % 3).cast("int").alias("task"), F.col("pos").alias("feature"), x.alias("x"), (x * (F.col("pos") + 1) / 64).alias("contrib"), (1.0 + 0.5 * (F.col("label") % 3)).alias("weight"))


CONTRIBUTIONS = """contrib AS (SELECT vec_id AS sample_id, CAST(vec_id % 5 AS INTEGER) AS fold, CAST(label % 3 AS INTEGER) AS task, pos AS feature, v AS x, v * (pos + 1) / 64 AS contrib, 1.0 + 0.5 * (label % 3) AS weight
  FROM (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings))"""


def voxels(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    y, x = F.floor(F.col("pos") / 8).cast("int"), (F.col("pos") % 8).cast("int")
    rows = e.select(F.floor(F.col("vec_id") / 3).cast("long").alias("case_id"), (F.col("vec_id") % 3).cast("int").alias("z"), y.alias("y"), x.alias("x"), (100 + 100 * F.col("v").cast("double")).alias("intensity"))
    label = F.when(F.col("y").between(1, 6) & F.col("x").between(1, 6), 7).when(F.col("x") == 7, 20).otherwise(0)
    return rows.withColumn("label", label)


VOXELS = """vox0 AS (SELECT vec_id // 3 AS case_id, CAST(vec_id % 3 AS INTEGER) AS z, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, 100 + 100 * v AS intensity
  FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)),
vox AS (SELECT *, CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN 7 WHEN x = 7 THEN 20 ELSE 0 END AS label FROM vox0)"""
