"""Micro frames, properties and edge rows."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import coral, keys, numeric
from gradeloom.operators import cleaning, explanation, harmonize, joins, linear, metrics, reshape, selection, splits, thresholds, voxels
from gradeloom.sources import tables


def test_numeric_constants():
    assert np.allclose(numeric.t_two_sided(np.array([0, 1, 2.0, 12.706204736, np.inf, np.nan]), np.array([5, 10, 1, 1, 3, 3])), [1, 0.340893132, 0.295167235, 0.05, 0, np.nan], atol=1e-8, equal_nan=True)
    assert abs(numeric.t_quantile(0.975, 4) - 2.776445105) < 1e-6
    assert math.isnan(numeric.t_quantile(0.975, 0))
    assert np.allclose(numeric.norm_ppf(np.array([0.5, 0.975, 0, 1])), [0, 1.959963985, -np.inf, np.inf])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(0.1, 5)), min_size=1, max_size=12))
def test_pool_adjacent_is_monotone_and_keeps_the_mean(rows):
    v, w = np.array(rows).T
    fit = numeric.pool_adjacent(v, w)
    assert np.all(np.diff(fit) >= -1e-9)
    assert abs((w * fit).sum() - (w * v).sum()) < 1e-6


def test_elastic_net_against_closed_forms():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 4))
    y = x @ [1.0, -2.0, 0.0, 0.5] + 0.1 * rng.standard_normal(200)
    g, m = x.T @ x / 200, x.T @ y / 200
    ridge = numeric.elastic_net(g, m, 0.3, 0.0)
    assert np.allclose(ridge, np.linalg.solve(g + 0.3 * np.eye(4), m), atol=1e-6)
    assert np.all(numeric.elastic_net(g, m, 1.0001 * np.abs(m).max(), 1.0) == 0)
    free = numeric.elastic_net(g, m, 100.0, 1.0, np.array([0.0, 1, 1, 1]))
    assert free[0] != 0 and np.all(free[1:] == 0)


def test_two_gaussians_finds_its_peaks():
    rng = np.random.default_rng(1)
    mean, _, share = numeric.two_gaussians(np.concatenate([rng.normal(0, 1, 400), rng.normal(8, 1, 400)]))
    assert np.allclose(mean, [0, 8], atol=0.3) and np.allclose(share, 0.5, atol=0.05)


def test_ids_and_grades(spark):
    rows = spark.createDataFrame([("12.0",), (" 012 ",), ("7",), (None,)], "id string")
    assert [r[0] for r in rows.select(keys.norm_id(F.col("id"))).collect()] == ["12", "012", "7", None]
    g = spark.createDataFrame([("IV",), ("3",), ("2.0",), ("9",), ("x",), (None,)], "g string")
    assert [r[0] for r in g.select(keys.grade_of(F.col("g"))).collect()] == [4, 3, 2, None, None, None]
    c = spark.createDataFrame([("12",), ("12_erosion",), ("12_dilation_trans_rot_mask",), ("3_x_image_mask",)], "case_id string")
    assert [r["condition"] for r in reshape.split_perturbed(c).collect()] == ["gold", "erosion", "dilation_trans_rot", "x_image"]


def test_decode_is_strict(spark):
    p = spark.createDataFrame([([0.9, 0.5, 0.5, 0.1],), ([0.6, 0.6, 0.2, 0.1],)], "p array<double>")
    got = p.select(coral.decode(F.col("p")).alias("y"), coral.class_probabilities(F.col("p")).alias("c")).collect()
    assert [r["y"] for r in got] == [2, 3]
    assert all(abs(sum(r["c"]) - 1) < 1e-12 for r in got)
    assert coral.ordered_thresholds([-1.0, 0.0, 0.0]) == [-1.0, 0.0, 1.0]


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "y_true int, y_pred int, y_cont double")


def test_metrics_of_degenerate_tables(spark):
    perfect = metrics.ordinal_metrics(_predictions(spark, [(k, k, float(k)) for k in range(1, 6)] * 2), [], 5).first()
    assert perfect["kappa_quadratic"] == 1 and perfect["mae"] == 0 and abs(perfect["spearman"] - 1) < 1e-12
    one = metrics.ordinal_metrics(_predictions(spark, [(3, 3, 3.0), (3, 3, 3.0)]), [], 5).first()
    assert (one["kappa_quadratic"], one["spearman"], one["ccc"], one["bacc"]) == (0, 0, 0, 0.2)
    assert metrics.ordinal_metrics(_predictions(spark, []), [], 5).count() == 0


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_metrics_do_not_depend_on_partitions(spark, partitions):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(1, 6, 300), rng.integers(1, 6, 300), rng.random(300).round(2), strict=True)]
    got = metrics.ordinal_metrics(_predictions(spark, rows).repartition(partitions), [], 5).first().asDict()
    frame = pd.DataFrame(rows, columns=["t", "p", "c"])
    assert abs(got["mae"] - (frame.t - frame.p).abs().mean()) < 1e-12
    assert abs(got["spearman"] - frame.t.rank().corr(frame.c.rank())) < 1e-9


def _long(spark, values):
    """values[condition][sample]"""
    rows = [(str(i), "L4-L5", f"c{k}" if k else "gold", "f", float(v)) for k, vs in enumerate(values) for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "case_id string, segment string, condition string, feature string, value double")


def test_icc(spark):
    assert abs(selection.icc21(_long(spark, [[1, 2, 4, 7]] * 3)).first()["icc"] - 1) < 1e-12
    flat = selection.icc21(_long(spark, [[2, 2, 2]] * 2)).first()
    assert flat["icc"] is None and flat["keep"] is False
    x = np.array([[9, 6, 8, 7, 10, 6], [2, 1, 4, 1, 5, 2], [5, 3, 6, 2, 6, 4], [8, 2, 8, 6, 9, 7]], float)  # a textbook table: 0.29
    assert abs(selection.icc21(_long(spark, x.tolist())).first()["icc"] - 0.2897638) < 1e-6


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, None, 0.5]
    rows = spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(p)], "feature string, p double")
    got = {r["feature"]: r["q"] for r in selection.benjamini_hochberg(rows).collect()}
    want = {"f3": 0.025, "f0": 0.025, "f2": 0.05, "f1": 0.05, "f5": 0.5}
    assert got.pop("f4") is None and all(abs(got[k] - v) < 1e-12 for k, v in want.items())


def test_deduplicate_order_and_ties(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("a", "c", -0.97), ("b", "c", 0.96), ("c", "d", 0.951)], "feature1 string, feature2 string, rho double")
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.9), ("d", None)], "feature string, score double")
    got = {r["feature"]: (r["kept"], r["removed_by"], r["removed_order"]) for r in selection.deduplicate(pairs, scores).collect()}
    assert got == {"b": (False, "a", 1), "a": (False, "c", 2), "c": (True, None, None), "d": (False, "c", 3)}


def test_spearman_p_matches_permutation_free_formula(spark):
    rows = spark.createDataFrame([("f", float(v), g) for v, g in zip([1, 2, 3, 4, 5, 6], [1, 1, 2, 2, 3, 2], strict=True)], "feature string, value double, pfirrmann int")
    t = selection.spearman_with(rows).withColumn("p", selection.p_value(F.col("rho"), F.col("n"))).first()
    r = pd.Series([1, 2, 3, 4, 5, 6]).corr(pd.Series([1, 1, 2, 2, 3, 2]).rank())
    assert abs(t["rho"] - r) < 1e-12
    assert abs(t["p"] - float(numeric.t_two_sided(np.array([r * math.sqrt(4 / (1 - r * r))]), 4)[0])) < 1e-12


def test_rank_gauss_follows_its_formula(spark):
    train, new = [3.0, 1.0, 2.0, 2.0], [0.0, 2.0, 9.0]
    frame = lambda v: spark.createDataFrame([(i, "f", x) for i, x in enumerate(v)], "id int, feature string, value double")
    u = {r["id"]: r["u"] for r in harmonize.rank_share(frame(train), frame(new)).collect()}
    assert u == {0: 0.125, 1: 0.625, 2: 0.875}
    z = numeric.norm_ppf(np.array([0.875, 0.125, 0.625, 0.625]))
    got = {r["id"]: r["value"] for r in harmonize.rank_gauss(frame(train), frame(new)).collect()}
    want = (numeric.norm_ppf(np.array([0.125, 0.625, 0.875])) - z.mean()) / z.std()
    assert np.allclose([got[i] for i in range(3)], want)


def test_mean_variance_leaves_unseen_batches(spark):
    rows = spark.createDataFrame([("f", "a", 1.0), ("f", "a", 3.0), ("f", "b", 10.0), ("f", "b", 14.0)], "feature string, batch string, value double")
    fitted = harmonize.mean_variance_fit(rows, "batch")
    out = harmonize.mean_variance_apply(rows, fitted, "batch").groupBy("batch").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()
    assert all(abs(r["m"] - 7) < 1e-5 for r in out) and len({round(r["s"], 4) for r in out}) == 1
    new = rows.withColumn("batch", F.lit("new"))
    assert [r["value"] for r in harmonize.mean_variance_apply(new, fitted, "batch").collect()] == [1.0, 3.0, 10.0, 14.0]


def test_combat_removes_a_planted_batch_shift(spark):
    rng = np.random.default_rng(4)
    rows = [(f"f{f}", b, int(c), float(f + c + {"a": 0, "b": 3, "c": -2}[b] + (1 + (b == "b")) * rng.standard_normal())) for f in range(30) for b in "abc" for c in rng.integers(0, 3, 60)]
    df = spark.createDataFrame(rows, "feature string, batch string, seg int, value double")
    fitted = harmonize.combat_fit(df, "batch", "seg")
    out = harmonize.combat_apply(df, fitted, "batch", "seg").toPandas()
    centred = out["value"] - out.groupby(["feature", "seg"])["value"].transform("mean")
    by = centred.groupby(out["batch"]).agg(["mean", "std"])
    assert by["mean"].abs().max() < 0.15 and by["std"].max() / by["std"].min() < 1.2
    with pytest.raises(ValueError, match="not fitted"):
        harmonize.combat_apply(df.withColumn("seg", F.lit(9)), fitted, "batch", "seg")
    ref = harmonize.combat_apply(df, harmonize.combat_fit(df, "batch", "seg", ref_batch="a"), "batch", "seg").where("batch = 'a'").toPandas()
    assert np.allclose(np.sort(ref["value"]), np.sort([r[3] for r in rows if r[1] == "a"]))


def test_pooling_needs_two_discs(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "patient string, x double")
    with pytest.raises(ValueError, match="single row"):
        cleaning.pool(rows, "patient", ["x"], ["mean-d"], "classic")
    out = cleaning.pool(rows.where("patient = 'a'"), "patient", ["x"], ["mean", "mean_-d"], "classic").orderBy("x").collect()
    assert [(r["pool_classic_mean__x"], r["pool_classic_mean_minus_d__x"]) for r in out] == [(2.0, 3.0), (2.0, 1.0)]


def test_grades_and_merges(spark):
    rows = spark.createDataFrame([("1", "L4-L5"), ("2", "L4-L5")], "case_id string, segment string")
    grades = spark.createDataFrame([("1", "L4-L5", 3)], "case_id string, segment string, pfirrmann int")
    with pytest.raises(ValueError, match="no grade"):
        joins.attach_grade(rows, grades)
    assert joins.attach_grade(rows, grades, "drop").count() == 1
    a = spark.createDataFrame([("1", 1.0, "x"), ("2", 2.0, "y")], "case_id string, v double, only string")
    b = spark.createDataFrame([("2", 9.0), ("3", 3.0)], "case_id string, v double")
    assert sorted((r["case_id"], r["v"], r["only"]) for r in joins.merge_features(a, b).collect()) == [("1", 1.0, "x"), ("2", 9.0, "y"), ("3", 3.0, None)]


def test_group_folds(spark):
    rows = spark.createDataFrame([(f"p{i}",) for i in range(23) for _ in range(1 + i % 4)], "patient string")
    found = splits.group_kfold(rows, "patient", 5)
    assert found.count() == 23 and found.select("patient").distinct().count() == 23
    loads = [r["count"] for r in rows.join(found, "patient").groupBy("fold").count().collect()]
    assert max(loads) - min(loads) <= 4 and len(loads) == 5
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, splits.group_kfold(rows.repartition(7), "patient", 5).collect()))
    with pytest.raises(ValueError, match="fewer"):
        splits.group_kfold(rows.limit(1), "patient", 5)


def test_threshold_search_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    grid = np.array([0.3, 0.5, 0.7])
    p = np.sort(rng.random((80, 2)), axis=1)[:, ::-1].round(3)
    y = rng.integers(1, 4, 80)
    rows = spark.createDataFrame([([float(a), float(b)], int(c), "g") for (a, b), c in zip(p, y, strict=True)], "p_gt array<double>, y_true int, key string")
    got = thresholds.calibrate(rows, ["key"], 3, grid, ("acc", "qwk", "-mae")).first()
    thr = np.array([0.5, 0.5])
    for _ in range(3):
        for k in range(2):
            best = None
            for c in grid:
                t = thr.copy()
                t[k] = c
                cm = np.zeros((3, 3))
                np.add.at(cm, (y - 1, (p > t).sum(axis=1)), 1)
                m = thresholds.scores_of(cm)
                score = (m["acc"], m["qwk"], -m["mae"])
                if best is None or score > best[0]:
                    best = (score, c)
            thr[k] = best[1]
    assert [got["thr1"], got["thr2"]] == list(thr)


def test_pls_on_moments_equals_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 5))
    y = rng.integers(1, 4, 60)
    x[:, 0] += y
    rows = spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    model = linear.sparse_pls(rows, 5, [1, 2, 3], [2, 5])
    xh, yh = x - x.mean(axis=0), (y[:, None] == [1, 2, 3]) - np.mean(y[:, None] == [1, 2, 3], axis=0)
    scores = linear.pls_scores(rows, model).toPandas()
    for h, keep in enumerate([2, 5]):
        w = np.linalg.svd(xh.T @ yh)[0][:, 0]
        w = w * np.sign(w[np.abs(w).argmax()])
        w[np.argsort(-np.abs(w))[keep:]] = 0
        w /= np.linalg.norm(w)
        t = xh @ w
        assert np.allclose(np.stack(scores["t"])[:, h], t, atol=1e-3)
        xh, yh = xh - np.outer(t, xh.T @ t / (t @ t)), yh - np.outer(t, yh.T @ t / (t @ t))
    assert np.allclose(np.stack(scores["prob"]).sum(axis=1), 1)


def test_cut_points(spark):
    rows = spark.createDataFrame([(1, float(i), 0.0 if i < 10 else 5.0 if i < 20 else 1.0) for i in range(30)], "task int, x double, g double")
    got = explanation.cut_points(rows, ["task"], "x", "g", [i / 29 for i in range(30)], 3).first()
    assert got["bounds"] == [9.0, 19.0] and got["ns"] == [10, 10, 10]


def test_components_join_diagonals():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 1]], bool)
    assert voxels.components8(m).max() == 4
    assert voxels.components8(np.zeros((2, 2), bool)).max() == 0


def test_rotation_about_the_middle(spark):
    vox = spark.createDataFrame([(1, 0, y, x, float(8 * y + x), 7 if y == x else 0) for y in range(8) for x in range(8)], "case_id long, z int, y int, x int, intensity double, label int")
    same = voxels.rotate(vox, 0.0, 8, 8)
    assert sorted((r["y"], r["x"], r["intensity"], r["label"]) for r in same.collect()) == sorted((r["y"], r["x"], r["intensity"], r["label"]) for r in vox.collect())
    assert voxels.noise(vox, 1.0, 3).exceptAll(voxels.noise(vox.repartition(5), 1.0, 3)).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "f.csv").write_text("﻿case_id, classic_L4-L5_a ,bad\n 1 ,2.5,x\n2,inf,3\n", encoding="utf-8")
    rows = tables.read_features(spark, str(tmp_path / "f.csv")).orderBy("case_id").collect()
    assert [tuple(r) for r in rows] == [("1", 2.5, None), ("2", None, 3.0)]
    (tmp_path / "g.csv").write_text("序号,L34,L4-L5\n1.0,II,3\n2,9,V\n", encoding="utf-8")
    got = tables.read_grades(spark, str(tmp_path / "g.csv"), ["L3-L4", "L4-L5"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("1", "L3-L4", 2), ("1", "L4-L5", 3), ("2", "L3-L4", None), ("2", "L4-L5", 5)], key=repr)
    (tmp_path / "s.csv").write_text('image_id,pixel_spacing,inversion_time\n7.0,"[0.5, 0.6]",\n7,"[9, 9]",1\n')
    stats = tables.read_statistics(spark, str(tmp_path / "s.csv")).collect()
    assert [(r["image_id"], r["spacing"]) for r in stats] == [("7", [0.5, 0.6])]
    for k in (0, 3):
        (tmp_path / f"fold_{k}").mkdir()
        (tmp_path / f"fold_{k}" / "val_predictions.csv").write_text(f"orig_index,y_true\n{k},1\n")
    assert sorted(r["fold"] for r in tables.read_predictions(spark, str(tmp_path / "fold_*" / "val_predictions.csv")).collect()) == [0, 3]
    (tmp_path / "m.csv").write_text("id,y,b,a\nx,1,2,3\nx,2,2,3\n")
    with pytest.raises(ValueError, match="not unique"):
        tables.read_model_input(spark, str(tmp_path / "m.csv"), "id", "y")
    images = spark.createDataFrame([("a/1.nii.gz",), ("a/2.nii",)], "path string")
    masks = spark.createDataFrame([("a/1_mask.nii",), ("a/1-seg.nii",), ("b/2.nii",)], "path string")
    assert [tuple(r) for r in tables.pair_images(images, masks).collect()] == [("a/1", "a/1.nii.gz", "a/1_mask.nii")]
    assert tables.chosen_columns(["b", "a", "c"], drop=["c"], order="sorted") == ["a", "b"]
    assert tables.feature_columns(["a", "x_path", "dscr_error", "dhi_error"]) == ["a", "dscr_error"]


def test_summary_table(spark, tmp_path):
    m = spark.createDataFrame([(0, 1.0), (1, 3.0)], "fold int, mae double")
    pooled = spark.createDataFrame([(1.9,)], "mae double")
    out = tables.write_summary(m, pooled, None, str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == [("0", 1.0), ("1", 3.0), ("fold_mean", 2.0), ("mean", 1.9)]
    tables.write_tables({"icc": m}, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t/icc")).count() == 2
