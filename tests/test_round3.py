"""Faults of the third round's findings: bounds made twice, absent levels, moments by the order of the pixels, fits of many settings."""

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gradeloom.operators import bootstrap, cleaning, harmonize, linear, logistic, ranks, reshape, voxels


def test_ranges_are_cut_once(spark, monkeypatch):
    """Bounds that come out otherwise each time they are made, as approximate ones may on a cluster, change no rank."""

    def uneven(value, shares, accuracy):
        @F.pandas_udf("array<double>")
        def cut(v: pd.Series) -> list:
            return np.sort(np.random.default_rng().choice(v.to_numpy(), ranks.RANGES - 1)).tolist()

        return cut.asNondeterministic()(value)

    monkeypatch.setattr(ranks, "FEW", 10)
    monkeypatch.setattr(F, "percentile_approx", uneven)
    rows = spark.createDataFrame([(f"f{i % 3}", float(i * 7919 % 2000)) for i in range(6000)], "feature string, value double").distinct().withColumn("n", F.lit(2))
    got = ranks.running_counts(rows, ["feature"], "value").toPandas()
    want = got.groupby("feature")["value"].rank() * 2 - 2
    assert (got["before"] == want).all()


def test_symmetric_masks_have_the_moments_of_the_sql(spark):
    """hu7 of masks that are their own mirror is 0 but for rounding, and the log shows that rounding; rows in any order give the same bits."""
    rng = np.random.default_rng(3)
    rows = []
    for case in range(40):
        half = {(int(y), int(x)) for y, x in rng.integers(0, 7, (9, 2))}
        rows += [(case, 0, y, x) for y, x in half | {(x, y) for y, x in half}]
    frame = pd.DataFrame(rows, columns=["case_id", "z", "y", "x"])

    def by_hand(px):  # C's pow, from the last pixel to the first
        n, cx, cy = len(px), px["x"].sum() / len(px), px["y"].sum() / len(px)
        m = dict.fromkeys(["30", "03", "21", "12"], 0.0)
        for y, x in sorted(zip(px["y"].tolist(), px["x"].tolist(), strict=True), reverse=True):
            dx, dy = x - cx, y - cy
            for k, v in {"30": math.pow(dx, 3), "03": math.pow(dy, 3), "21": dx * dx * dy, "12": dx * dy * dy}.items():
                m[k] += v
        a, b, c, d = (v / math.pow(n, 2.5) for v in m.values())
        return (3 * c - b) * (a + d) * ((a + d) ** 2 - 3 * (c + b) ** 2) - (a - 3 * d) * (c + b) * (3 * (a + d) ** 2 - (c + b) ** 2)

    want = {case: by_hand(px) for case, px in frame.groupby("case_id")}
    for seed in (1, 2):
        mask = spark.createDataFrame(frame.sample(frac=1, random_state=seed)).repartition(5)
        got = {r["case_id"]: r["hu7"] for r in voxels.hu_moments(mask, ["case_id", "z"]).collect()}
        assert got == want


def test_absent_levels_give_no_rows(spark):
    wide = spark.createDataFrame([("1", 1.0, None, 3.0), ("2", None, None, 4.0)], "case_id string, `Deep_L1-L2_0` double, `Deep_L1-L2_1` double, `Deep_L2-L3_0` double")
    long = {tuple(r) for r in reshape.wide_to_long(wide, ["case_id"], absent=False).collect()}
    assert long == {("1", "L1-L2", "Deep_0", 1.0), ("1", "L1-L2", "Deep_1", None), ("1", "L2-L3", "Deep_0", 3.0), ("2", "L2-L3", "Deep_0", 4.0)}
    assert reshape.wide_to_long(wide, ["case_id"]).count() == 6


def test_logistic_settings_share_their_passes(spark):
    """All folds and settings take few jobs together, and each fit is the optimum that Spark's own comes to."""
    rng = np.random.default_rng(8)
    y = np.arange(200) % 4 + 1
    x = rng.standard_normal((200, 2)) + y[:, None] * [0.7, -0.3]
    keep = (np.arange(200) % 5 == 0) | (y != 4)  # one class is in one fold only
    rows = spark.createDataFrame([(int(i % 5), x[i].tolist(), float(y[i])) for i in range(200) if keep[i]], "fold int, t array<double>, y double").persist()
    spark.sparkContext.setJobGroup("grid", "grid")
    got = {(r["inverse_penalty"], r["class_weight"]): r for r in linear.logistic_grid(rows, "fold", 4).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid"))
    spark.sparkContext.setJobGroup("other", "other")
    assert len(got) == 6 and all(r["n"] == keep.sum() for r in got.values()) and jobs < 100

    data = rows.select((F.col("fold") + 1).alias("f"), F.col("y").cast("int").alias("y"), F.col("t").alias("x"))
    for f in (1, 3):
        n = np.array([((y == c) & keep & (np.arange(200) % 5 != f - 1)).sum() for c in range(1, 5)], float)
        balanced = np.where(n > 0, n.sum() / ((n > 0).sum() * np.maximum(n, 1)), 0)
        (beta,) = logistic.fit(data, [(f, 1.0, balanced)], [1, 2, 3, 4], 2)
        train = linear.balanced_weights(rows.where(F.col("fold") != f - 1), "y").withColumn("v", array_to_vector("t"))
        fit = LogisticRegression(featuresCol="v", labelCol="y", weightCol="w", family="multinomial", standardization=False, regParam=1 / n.sum(), tol=1e-12, maxIter=1000).fit(train)
        z = x @ beta[:, :2].T + beta[:, 2]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        theirs = x @ fit.coefficientMatrix.toArray().T + fit.interceptVector.toArray()
        q = np.exp(theirs - theirs.max(axis=1, keepdims=True))[:, 1:]
        p, q = p / p.sum(axis=1, keepdims=True), np.pad(q / q.sum(axis=1, keepdims=True), ((0, 0), (0, 4 - q.shape[1])))
        assert np.abs(p - q).max() < 1e-4


def test_bootstrap_ranks_of_shared_values_reach_a_task_added_up(spark, monkeypatch):
    """A task that sums ranks gets each value of a range once, whatever the rows and partitions that share it; the sums are the same."""
    rng = np.random.default_rng(6)
    seen = spark.sparkContext.accumulator(0)
    frame = pd.DataFrame({"y_true": rng.integers(1, 4, 4000), "y_cont": rng.integers(0, 30, 4000) / 7, "n": 1, "w": [bytes(v) for v in rng.integers(0, 3, (4000, 5)).astype(np.uint8)]})
    rows = spark.createDataFrame(frame, "y_true int, y_cont double, n long, w binary").repartition(16)
    whole, sums_of = bootstrap.range_sums(frame["y_cont"].to_numpy(), frame["y_true"].to_numpy(), bootstrap.draw_matrix(frame["w"], 5), 3), bootstrap.range_sums

    def counted(value, group, weight, classes):
        seen.add(len(value))
        return sums_of(value, group, weight, classes)

    monkeypatch.setattr(bootstrap, "range_sums", counted)
    monkeypatch.setattr(bootstrap, "SORTED", 300)
    got = sorted(bootstrap.rank_sums(rows, 3, 5, np.array([]), bootstrap.FANS).collect())
    assert np.allclose([r["sums"] for r in got], whole)
    assert seen.value <= 30 * 3


def test_few_keys_are_not_dealt_to_tasks(spark):
    """Tables of a row a feature or segment go to the rows: a join that deals rows by one of a few keys puts each key's in one task."""
    long = spark.createDataFrame([(str(i), "s", c, f"f{i % 2}", i * 1.0 if i % 5 else None, 1.0) for i in range(20) for c in ("gold", "other")], "case_id string, segment string, condition string, feature string, value double, weight double")
    table = long.groupBy("feature").agg(F.avg("value").alias("median"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out, joins in (
            (cleaning.impute(long, table.select("feature", "median")), 0),
            (harmonize.zscore_apply(long, table.select("feature", "mean", "sd")), 0),
            (cleaning.residualize(long, "feature", ["value"], "weight"), 0),
            (cleaning.align(long, 2), 1),  # that of the samples
        ):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == joins and "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
