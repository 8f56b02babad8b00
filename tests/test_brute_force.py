"""Operators without SQL against brute force on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from bootstrap_draws import draws_by_cluster
from pyspark.sql import functions as F

from gradeloom.functions import coral, keys, numeric
from gradeloom.operators import explanation, harmonize, linear, metrics, ranks, reshape, selection, splits, thresholds, voxels
from gradeloom.sources import tables

CLASSES = 4


# ranks and percentiles


@pytest.mark.parametrize("few", [500_000, 0])
def test_ranks_and_percentiles(spark, monkeypatch, few):
    """few 0: values go by ranges; with an outlier, a heavy value and a key of one row."""
    monkeypatch.setattr(ranks, "FEW", few)
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.standard_normal(700).round(2), np.full(300, 0.25), [1e12, -1e9]])
    frame = pd.DataFrame({"k": ["a"] * 600 + ["b"] * 401 + ["c"], "v": v})
    rows = spark.createDataFrame(frame).repartition(5)
    got = ranks.average_rank(rows.withColumn("n", F.lit(1)), ["k"], "v").toPandas().set_index(["k", "v"])["rank"]
    want = frame.assign(rank=frame.groupby("k")["v"].rank()).drop_duplicates(["k", "v"]).set_index(["k", "v"])["rank"]
    assert (got.sort_index() == want.sort_index()).all() and len(got) == len(want)
    shares = [0, 0.1, 0.5, 0.975, 1]
    q = {r["k"]: r["q"] for r in ranks.percentiles(rows, ["k"], "v", shares).collect()}
    for k, part in frame.groupby("k"):
        assert np.allclose(q[k], np.percentile(part["v"], [100 * s for s in shares]), rtol=1e-9)
    assert abs(ranks.median(rows, [], "v").first()["median"] - frame["v"].median()) < 1e-9
    assert ranks.percentiles(rows.limit(0), ["k"], "v", shares).count() == 0
    assert ranks.average_rank(rows.limit(0).withColumn("n", F.lit(1)), [], "v").count() == 0


# predictions


def _rows(spark, seed=1, n=240):
    rng = np.random.default_rng(seed)
    y = rng.integers(1, CLASSES + 1, n)
    s = y - 2.5 + rng.standard_normal(n)
    p = np.round(1 / (1 + np.exp(-(s[:, None] - np.array([-1.0, 0, 1])))), 4)
    cont = 1 + p.sum(axis=1)
    pred = 1 + (p > 0.5).sum(axis=1)
    data = [(int(i % 40), int(i % 3), int(i % 5), int(a), [float(x) for x in b], float(c), int(d)) for i, (a, b, c, d) in enumerate(zip(y, p, cont, pred, strict=True))]
    frame = pd.DataFrame(data, columns=["patient_id", "task", "fold", "y_true", "p_gt", "y_cont", "y_pred"])
    return frame, spark.createDataFrame(data, "patient_id long, task int, fold int, y_true int, p_gt array<double>, y_cont double, y_pred int").repartition(3)


GRID = np.array([0.3, 0.4, 0.5, 0.6, 0.7])
WANT = ["acc", "bacc", "qwk", "-mae"]


def _table(y, pred):
    cm = np.zeros((CLASSES, CLASSES))
    np.add.at(cm, (y - 1, pred - 1), 1)
    return cm


def _descent(p, y, objective=WANT, grid=GRID, rounds=3):
    thr = np.full(CLASSES - 1, 0.5)
    for _ in range(rounds):
        before = thr.copy()
        for k in range(CLASSES - 1):
            best = None
            for c in grid:
                t = thr.copy()
                t[k] = c
                m = thresholds.scores_of(_table(y, 1 + (p > t).sum(axis=1)))
                score = tuple(-m[o[1:]] if o[0] == "-" else m[o] for o in objective)
                if best is None or score > best[0]:
                    best = (score, c)
            thr[k] = best[1]
        if (thr == before).all():
            break
    return thr


@pytest.mark.parametrize("rows_at_once", [200_000, 0])
def test_threshold_variants_and_nested(spark, monkeypatch, rows_at_once):
    """rows_at_once 0: every step of the search is an aggregation."""
    monkeypatch.setattr(thresholds, "DRIVER_ROWS", rows_at_once)
    frame, rows = _rows(spark)
    p, y, fold, task = np.stack(frame["p_gt"]), frame["y_true"].to_numpy(), frame["fold"].to_numpy(), frame["task"].to_numpy()
    own = {f: _descent(p[fold == f], y[fold == f]) for f in range(5)}
    rest = {f: _descent(p[fold != f], y[fold != f]) for f in range(5)}
    whole, middle = _descent(p, y), np.median(np.stack(list(own.values())), axis=0)
    sets = {"baseline": {f: np.full(3, 0.5) for f in own}, "all_to_all": {f: whole for f in own}, "fold_to_fold": own, "others_to_fold": rest, "median_to_all": {f: middle for f in own}}
    got = {r["variant"]: r for r in thresholds.variants(rows, CLASSES, grid=GRID).collect()}
    for name, by in sets.items():
        pred = 1 + (p > np.stack([by[f] for f in fold])).sum(axis=1)
        m = thresholds.scores_of(_table(y, pred))
        assert all(abs(got[name][k] - m[k]) < 1e-12 for k in ("acc", "bacc", "qwk", "mae", "macro_f1")), name
    nested = {r["task"]: [r["thr1"], r["thr2"], r["thr3"]] for r in thresholds.nested_medians(rows, CLASSES, grid=GRID).collect()}
    for t in range(3):
        want = np.median([_descent(p[(fold != f) & (task == t)], y[(fold != f) & (task == t)]) for f in range(5)], axis=0)
        assert np.allclose(nested[t], want)
    over = frame["y_cont"].to_numpy()[:, None] - np.arange(1, CLASSES)
    offsets = {r["task"]: [r["thr1"], r["thr2"], r["thr3"]] for r in thresholds.calibrate_offsets(rows, ["task"], CLASSES, GRID).collect()}
    assert all(np.allclose(offsets[t], _descent(over[task == t], y[task == t], ["acc", "qwk", "-mae"])) for t in range(3))


def test_metrics_by_sets_equal_each_alone(spark):
    _, rows = _rows(spark)
    rows = rows.withColumn("fold", F.when(F.col("fold") < 4, F.col("fold")))  # a null key is a group of its set
    got = metrics.metrics_by_sets(rows, [[], ["task"]], CLASSES).toPandas()
    want = metrics.ordinal_metrics(rows, ["task"], CLASSES).toPandas().set_index("task").sort_index()
    by_task = got[got["grouping"] == "task"].set_index("task").sort_index()
    assert all(np.allclose(by_task[c].to_numpy(float), want[c].to_numpy(float)) for c in want.columns)
    assert metrics.metrics_by_sets(rows, [["fold"]], CLASSES).count() == 5


def test_loss_of_far_scores_is_finite(spark):
    rows = spark.createDataFrame([(1, 1000.0, 1.0), (4, -1000.0, 3.0), (2, 0.3, 2.0)], "y int, s double, w double")
    each = coral.loss(F.col("y"), coral.logits(F.col("s"), [-1.0, 0.0, 1.0]))
    got = [r[0] for r in rows.select(each).collect()]
    x = np.array([0.3 + 1, 0.3, 0.3 - 1])
    assert got[:2] == [1000.0, 1000.0] and abs(got[2] - np.mean(np.maximum(x, 0) - x * [1, 0, 0] + np.log1p(np.exp(-np.abs(x))))) < 1e-12
    assert abs(rows.agg(coral.mean_loss(each, F.col("w"))).first()[0] - (1000 + 3000 + 2 * got[2]) / 6) < 1e-9


def test_iteration_candidates(spark):
    history = spark.createDataFrame([(f, i, abs(i - 4 - f) / 10) for f in range(2) for i in range(12)], "fold int, iteration int, value double")
    listed = lambda df: sorted(map(tuple, df.collect()))
    assert listed(linear.iteration_candidates(history, "window", window=2)) == [(0, i) for i in range(2, 7)] + [(1, i) for i in range(3, 8)]
    assert listed(linear.iteration_candidates(history, "topk_reg", top=2)) == [(0, 3), (0, 4), (1, 4), (1, 5)]
    assert listed(linear.iteration_candidates(history, "topk_reg", "auc", top=1)) == [(0, 11), (1, 11)]
    assert linear.iteration_candidates(history, "all").count() == 24
    with pytest.raises(ValueError, match="strategy"):
        linear.iteration_candidates(history, "none")


# linear models


def _vectors(spark, seed=2, n=90, p=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, p))
    y = np.clip(np.round(3 + x @ [1, -0.5, 0, 0] + 0.5 * rng.standard_normal(n)), 1, 5)
    w, seg, fold, case = rng.uniform(0.5, 1.5, n), np.arange(n) % 3, np.arange(n) % 4, np.arange(n) // 3
    rows = [(str(c), f"s{s}", int(f), [float(v) for v in a], float(b), float(m)) for c, s, f, a, b, m in zip(case, seg, fold, x, y, w, strict=True)]
    return x, y, w, seg, fold, case, spark.createDataFrame(rows, "case_id string, segment string, fold int, x array<double>, y double, w double").repartition(3)


def _residuals(x, y, w, seg, train):
    """Rows less their segment's weighted training mean, scaled by the training residuals' mean and deviation."""
    xr, yr = x.copy(), y.copy()
    for s in np.unique(seg):
        t = train & (seg == s)
        xr[seg == s] -= np.average(x[t], axis=0, weights=w[t])
        yr[seg == s] -= np.average(y[t], weights=w[t])
    return (xr - xr[train].mean(axis=0)) / xr[train].std(axis=0), yr


def test_lambda_choice(spark):
    x, y, w, seg, fold, _, rows = _vectors(spark)
    got = linear.choose_lambda(rows, "fold", "segment", 4, n=8).toPandas()
    errors = []
    for f in range(4):
        train = fold != f
        z, r = _residuals(x, y, w, seg, train)
        wt = w[train] / w[train].sum()
        gram, moment = (z[train] * wt[:, None]).T @ z[train], (z[train] * wt[:, None]).T @ r[train]
        held = []
        for a in got["alpha"]:
            b = numeric.elastic_net(gram, moment, a, 0.5)
            held.append(np.average((r[~train] - z[~train] @ b) ** 2, weights=w[~train]))
        errors.append(held)
    e = np.array(errors)
    assert np.allclose(got["cv_mean_mse"], e.mean(axis=0), atol=1e-6) and np.allclose(got["cv_se"], e.std(axis=0, ddof=1) / 2, atol=1e-6)
    best = e.mean(axis=0).argmin()
    assert got["selected"].to_numpy().argmax() == np.flatnonzero(e.mean(axis=0) <= e.mean(axis=0)[best] + e[:, best].std(ddof=1) / 2)[0]


@pytest.mark.parametrize("held_bytes", [64 << 20, 1])
def test_stability(spark, monkeypatch, held_bytes):
    """held_bytes 1: a pass over the rows for each replicate."""
    monkeypatch.setattr(linear, "HELD_BYTES", held_bytes)
    x, y, w, seg, _, case, rows = _vectors(spark)
    names, b = list("abcd"), 6
    got = linear.stability(rows, "case_id", "segment", names, 0.05, replicates=b).toPandas().set_index("feature")
    drawn = draws_by_cluster(rows, "case_id", b)
    drawn = np.array([drawn[str(c)] for c in case])
    betas = []
    for r in range(b):
        at = np.repeat(np.arange(len(y)), drawn[:, r].astype(int))
        z, res = _residuals(x[at], y[at], w[at], seg[at], np.ones(len(at), bool))
        wt = w[at] / w[at].sum()
        betas.append(np.abs(numeric.elastic_net((z * wt[:, None]).T @ z, (z * wt[:, None]).T @ res, 0.05, 0.5)))
    betas = np.array(betas)
    assert np.allclose(got.loc[names, "mean_abs_beta"], betas.mean(axis=0), atol=1e-5)
    assert np.allclose(got.loc[names, "pi"], (betas > 1e-6).mean(axis=0))


def test_grid_search(spark):
    x, y, _, _, fold, _, rows = _vectors(spark)
    got = linear.grid_search(rows.withColumn("w", F.lit(1.0)), "fold", 4, 5, [0.5, 1.0], n=4).toPandas()
    for _, r in got.iterrows():
        wrong = []
        for f in range(4):
            t = fold != f
            mx, my = x[t].mean(axis=0), y[t].mean()
            z = x[t] - mx
            b = numeric.elastic_net(z.T @ z / t.sum(), z.T @ (y[t] - my) / t.sum(), r["alpha"], r["l1_ratio"])
            pred = np.clip(np.floor((x[~t] - mx) @ b + my + 0.5), 1, 5)
            wrong.append(np.abs(pred - y[~t]).mean())
        assert abs(r["mae"] - np.mean(wrong)) < 1e-6 and abs(r["se"] - np.std(wrong, ddof=1) / 2) < 1e-6
    assert got["rule_min"].sum() == 1 and got["rule_1se"].sum() == 1 and got[got["rule_min"]]["mae"].iloc[0] == got["mae"].min()


def test_nearest_centroid_with_scale(spark):
    rng = np.random.default_rng(3)
    t, y = rng.standard_normal((60, 2)), np.arange(60) % 3 + 1.0
    rows = spark.createDataFrame([(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(t, y, strict=True))], "i int, t array<double>, y double")
    scale = linear.inverse_diagonal(rows, 2)
    cov = sum(np.cov(t[y == c].T, bias=True) * (y == c).sum() for c in (1, 2, 3)) / 57
    assert np.allclose(scale, np.diag(np.linalg.inv(cov + 1e-3 * np.eye(2))))
    got = linear.nearest_centroid(rows, linear.centroids(rows, 2, []), [1.0, 2.0, 3.0], scale).orderBy("i").toPandas()
    mean = np.stack([t[y == c].mean(axis=0) for c in (1, 2, 3)])
    d = np.sqrt((((t[:, None] - mean) ** 2) * scale).sum(axis=2))
    e = np.exp(-(d - d.min(axis=1, keepdims=True)))
    assert (got["y_near"] == d.argmin(axis=1) + 1).all() and np.allclose(got["y_near_cont"], (e / e.sum(axis=1, keepdims=True)) @ [1, 2, 3])


def test_logistic_grid(spark):
    rng = np.random.default_rng(4)
    y = np.arange(120) % 3 + 1
    rows = spark.createDataFrame([(int(i % 2), [float(v) for v in rng.standard_normal(2) + c], float(c)) for i, c in enumerate(y)], "fold int, t array<double>, y double")
    got = linear.logistic_grid(rows, "fold", 3, cs=(0.01, 1.0)).toPandas()
    assert len(got) == 4 and (got["n"] == 120).all() and (got["acc"] > 0.4).all()
    w = linear.balanced_weights(spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "y double"), "y").collect()
    assert sorted(r["w"] for r in w) == [4 / 6, 4 / 6, 4 / 6, 2.0]


# harmonisation


def _combat(frame, parametric):
    """The textbook model on rows: design of batches and covariate levels, pooled scale, empirical Bayes."""
    out, hats = {}, {}
    batches, levels = sorted(frame["batch"].unique()), sorted(frame["seg"].unique())
    for f, part in frame.groupby("feature"):
        d = np.stack([(part["batch"] == b).to_numpy(float) for b in batches] + [(part["seg"] == c).to_numpy(float) for c in levels[1:]], 1)
        v = part["value"].to_numpy()
        beta = np.linalg.lstsq(d, v, rcond=None)[0]
        n = d[:, : len(batches)].sum(axis=0)
        scale = math.sqrt(((v - d @ beta) ** 2).mean())
        stand = n @ beta[: len(batches)] / n.sum() + d[:, len(batches) :] @ beta[len(batches) :]
        z = (v - stand) / scale
        out[f] = (part, stand, scale, z)
        for b in batches:
            at = (part["batch"] == b).to_numpy()
            hats[f, b] = (z[at].mean(), z[at].var(ddof=1), z[at])
    values = {}
    for f, (part, stand, scale, z) in out.items():
        adjusted = np.empty(len(part))
        for b in batches:
            g, d, rows = hats[f, b]
            if parametric:
                gs, ds = np.array([hats[k, b][0] for k in out]), np.array([hats[k, b][1] for k in out])
                t2, m, s2, n = gs.var(ddof=1), ds.mean(), ds.var(ddof=1), len(rows)
                a, c = (2 * s2 + m**2) / s2, (m * s2 + m**3) / s2
                gamma, delta = g, d
                for _ in range(500):
                    gamma = (t2 * n * g + delta * gs.mean()) / (t2 * n + delta)
                    delta = (c + 0.5 * ((rows - gamma) ** 2).sum()) / (n / 2 + a - 1)
            else:
                like, pairs = [], []
                for k in out:
                    if k != f:
                        gk, dk = hats[k, b][:2]
                        like.append(np.prod(np.exp(-((rows - gk) ** 2) / (2 * dk)) / math.sqrt(2 * math.pi * dk)))
                        pairs.append((gk, dk))
                gamma, delta = np.average(np.array(pairs), axis=0, weights=like)
            at = (part["batch"] == b).to_numpy()
            adjusted[at] = (z[at] - gamma) / math.sqrt(delta) * scale + stand[at]
        values[f] = dict(zip(part["id"], adjusted, strict=True))
    return values


@pytest.mark.parametrize("parametric", [True, False])
def test_combat_against_rows(spark, parametric):
    rng = np.random.default_rng(5)
    rows = [(i, f"f{f}", "ab"[i % 2], int(i // 2 % 3), float(f + (i % 2) * (1 + 0.2 * f) + i // 2 % 3 + (1 + i % 2) * rng.standard_normal())) for f in range(6) for i in range(24)]
    frame = pd.DataFrame(rows, columns=["id", "feature", "batch", "seg", "value"])
    df = spark.createDataFrame(rows, "id int, feature string, batch string, seg int, value double")
    got = harmonize.combat_apply(df, harmonize.combat_fit(df, "batch", "seg", parametric=parametric, rounds=500), "batch", "seg").collect()
    want = _combat(frame, parametric)
    assert len(got) == len(rows) and all(abs(r["value"] - want[r["feature"]][r["id"]]) < 1e-6 for r in got)


def test_pca(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 3)) @ rng.standard_normal((3, 5)) + 0.1 * rng.standard_normal((50, 5))
    long = spark.createDataFrame([(str(i), "s", f"f{j}", float(x[i, j])) for i in range(50) for j in range(5)], "case_id string, segment string, feature string, value double")
    loadings, variance = harmonize.pca_fit(long, ["case_id", "segment"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    share = s**2 / (s**2).sum()
    k = int(np.searchsorted(np.cumsum(share), 0.95) + 1)
    got = variance.orderBy("component").toPandas()
    assert len(got) == k and np.allclose(got["share"], share[:k])
    scores = harmonize.pca_apply(long, ["case_id", "segment"], harmonize.zscore_fit(long), loadings).toPandas()
    for c in range(k):
        mine = scores[scores["feature"] == f"PC_{c}"].assign(i=lambda d: d["case_id"].astype(int)).sort_values("i")["value"].to_numpy()
        assert np.allclose(np.abs(mine), np.abs(u[:, c] * s[c]), atol=1e-8)


# splits


def _groups(spark, sizes, seed=7):
    rng = np.random.default_rng(seed)
    rows = [(f"g{g}", int(y), f"m{g % 3}") for g, n in enumerate(sizes) for y in rng.integers(1, CLASSES + 1, n)]
    return rows, spark.createDataFrame(rows, "patient string, y int, scanner string")


def _cost(state, target):
    return ((state - target) ** 2).sum()


def test_stratified_split_is_even(spark):
    rows, df = _groups(spark, [3] * 100 + [7] * 20)
    found = {r["patient"]: r["fold"] for r in splits.stratified_group_kfold(df, "patient", "y", CLASSES, 5).collect()}
    assert len(found) == 120 and set(found.values()) == set(range(5))
    frame = pd.DataFrame(rows, columns=["patient", "y", "scanner"]).assign(fold=lambda d: d["patient"].map(found))
    share = frame.groupby(["fold", "y"]).size().unstack(fill_value=0) / frame.groupby("y").size()
    assert (share - 0.2).abs().to_numpy().max() < 0.04
    # 40 groups of one class are dealt eight to a fold
    alike = spark.createDataFrame([(f"a{g}", 1 + k) for g in range(40) for k in range(2)], "patient string, y int")
    counts = [r["count"] for r in splits.stratified_group_kfold(alike, "patient", "y", CLASSES, 5).groupBy("fold").count().collect()]
    assert counts == [8] * 5


def test_balanced_split_score_and_restarts(spark):
    rows, df = _groups(spark, [int(n) for n in np.random.default_rng(8).integers(2, 9, 60)])
    frame = pd.DataFrame(rows, columns=["patient", "y", "scanner"])

    def score(fold):
        f = frame.assign(fold=frame["patient"].map(fold))
        total = 0.0
        for k in range(3):
            part = f[f["fold"] == k]
            for y in range(1, CLASSES + 1):
                t = (frame["y"] == y).sum() / 3
                total += ((part["y"] == y).sum() / t - 1) ** 2
            for s in ("m0", "m1", "m2"):
                t = frame[frame["scanner"] == s]["patient"].nunique() / 3
                total += (part[part["scanner"] == s]["patient"].nunique() / t - 1) ** 2
            total += 0.2 * (len(part) / (len(frame) / 3) - 1) ** 2 + 0.2 * (part["patient"].nunique() / 20 - 1) ** 2
        return total

    found = splits.balanced_split(df, "patient", "y", "scanner", CLASSES, 3, trials=20).collect()
    fold = {r["patient"]: r["fold"] for r in found}
    assert len(fold) == 60 and abs(found[0]["score"] - score(fold)) < 1e-9
    rng = np.random.default_rng(9)
    assert found[0]["score"] < min(score({p: int(rng.integers(3)) for p in fold}) for _ in range(50))
    one = splits.balanced_split(df, "patient", "y", "scanner", CLASSES, 3, trials=1).first()["score"]
    assert found[0]["score"] <= one


def test_nested_split(spark):
    _, df = _groups(spark, [3] * 30)
    outer = splits.group_kfold(df, "patient", 5)
    found = splits.nested_split(df, "patient", outer, 3).toPandas()
    held = {r["patient"]: r["fold"] for r in outer.collect()}
    for f, part in found.groupby("outer"):
        assert set(part["patient"]) == {p for p, k in held.items() if k != f} and not part["patient"].duplicated().any() and set(part["fold"]) == {0, 1, 2}


# names, files, volumes


def test_names_of_levels():
    assert keys.dummy_name("field strength", ">=1.5 T", "meta_") == "meta_field_strength__ge_1.5_T"
    assert keys.dummy_name("m", "a/b=c") == "m__a_beq_c" and keys.dummy_name("m", " -- ") == "m__empty" and keys.dummy_name("m", "1.5") != keys.dummy_name("m", "1-5")
    assert keys.forced_names([" Deep_L3-L4_7 ", "Deep_9", "Deep_L4-L5_7", "", "Deep_9"]) == ["Deep_7", "Deep_9"]
    assert reshape.grade_columns(["l3-l4", "Grade L4/L5 "], ["L3-L4", "L4-L5"]) == {"L3-L4": "l3-l4", "L4-L5": "Grade L4/L5 "}
    with pytest.raises(ValueError, match="no grade column"):
        reshape.grade_columns(["x"], ["L3-L4"])


def test_levels_families_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("Deep", 1), ("deep_2", 2), ("x_1", 3)], "name string, n int")
    assert [r[0] for r in rows.select(keys.family_of(F.col("name"))).collect()] == [None, "deep", None]
    with pytest.raises(ValueError, match="no row"):
        reshape.only_levels(rows, "name", ["y"])
    tables.write_json({"t": rows.withColumn("a", F.array(F.lit(1.5)))}, str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j/t"))
    assert sorted((r["name"], r["n"], r["a"]) for r in back.collect()) == sorted((n, k, [1.5]) for n, k in [("Deep", 1), ("deep_2", 2), ("x_1", 3)])


def test_half_turn_about_the_mask(spark):
    """A half turn about a mask's centroid maps the mask onto itself; a volume without a mask turns about the middle."""
    cells = [(c, z, y, x, float(10 * y + x), 7 if c == 1 and 1 <= y <= 2 and 2 <= x <= 4 else 0) for c in (1, 2) for z in range(2) for y in range(6) for x in range(6)]
    vox = spark.createDataFrame(cells, "case_id long, z int, y int, x int, intensity double, label int")
    got = {(r["case_id"], r["z"], r["y"], r["x"]): (r["intensity"], r["label"]) for r in voxels.rotate_about_mask(vox, 180.0, 6, 6).collect()}
    assert len(got) == len(cells)
    for c, z, y, x, _, label in cells:
        sy, sx = (3 - y, 6 - x)
        if c == 1:
            inside = 0 <= sy < 6 and 0 <= sx < 6
            assert got[c, z, y, x] == pytest.approx((10 * sy + sx if inside else 0, label))
        else:
            sy, sx = 6 - y, 6 - x
            assert got[c, z, y, x][0] == pytest.approx(10 * sy + sx if sy < 6 and sx < 6 else 0)
    assert voxels.slice_axis((4.0, 0.7, 0.7)) == "z" and voxels.slice_axis((0.7, 0.7, 3.0)) == "x"


def test_monotone_medians(spark):
    rows = spark.createDataFrame([("f", 1 + i % 3, float(v)) for i, v in enumerate([1, 5, 3, 2, 6, 4, 3, 7, 5])], "feature string, pfirrmann int, value double")
    signs = spark.createDataFrame([("f", 0.4)], "feature string, rho double")
    got = selection.monotonicity(rows, signs, 0.1).first()
    med = np.array([2.0, 6.0, 4.0])
    fit = np.array([2.0, 5.0, 5.0])
    assert abs(got["delta"] - ((med - fit) ** 2).sum() / ((med - med.mean()) ** 2).sum()) < 1e-12 and not got["keep"]


def test_cut_points_with_ties(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0)] * 5 + [(1, 1.0, 4.0)] * 5, "task int, x double, g double")
    assert explanation.cut_points(rows, ["task"], "x", "g", [0.1, 0.5, 0.9], 3).count() == 0  # fewer distinct values than segments
    two = explanation.cut_points(rows, ["task"], "x", "g", [0.1, 0.5, 0.9], 2).first()
    assert two["ns"] == [5, 5] and two["means"] == [1.0, 4.0]
