"""Grades, names, hot joins, interactions by bounds, exact bootstrap and wide matrices against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from bootstrap_draws import draws_by_cluster

from gradeloom.functions import keys, numeric
from gradeloom.operators import bootstrap, cutpoints, explanation, gram, harmonize, interactions, joins, metrics, ranks, selection, slices, splits, thresholds, voxels
from gradeloom.sources import tables


def test_null_grades_and_series(spark):
    rows = spark.createDataFrame([("1", "L4-L5"), ("2", "L4-L5"), ("3", "L4-L5"), ("1", "L4-L5")], "case_id string, segment string")
    grades = spark.createDataFrame([("1", "L4-L5", 3), ("2", "L4-L5", None), ("9", "L4-L5", 1)], "case_id string, segment string, pfirrmann int")
    assert sorted((r["case_id"], r["pfirrmann"]) for r in joins.attach_grade(rows, grades, "drop").collect()) == [("1", 3), ("1", 3)]
    with pytest.raises(ValueError, match="no grade for .*'2'.*|no grade for .*'3'"):
        joins.attach_grade(rows, grades)
    with pytest.raises(ValueError, match="2 samples have no grade"):
        joins.grade_series(rows, grades)
    one = rows.where("case_id = '1'")
    assert [tuple(r) for r in joins.grade_series(one, grades).collect()] == [("1", "L4-L5", 3.0)] * 2
    assert joins.grade_series(one.limit(0), grades).count() == 0
    with pytest.raises(ValueError, match="several grades"):
        joins.grade_series(one, grades.union(grades))
    assert joins.grade_series(one, grades.union(grades.where("case_id = '9'"))).count() == 2  # repeats of others do no harm


def test_forced_names_lose_one_part():
    assert keys.forced_names(["Deep_L3-L4_a_L4-L5_b", " Deep_L4-L5_x_L3-L4_y ", "a_L5-S1_b_L5-S1_c", "plain", "", None, "plain", "Deep_a_L4-L5_b"]) == ["Deep_a_L4-L5_b", "Deep_L4-L5_x_y", "a_b_L5-S1_c", "plain", "Deep_a_b"]


def test_hot_values_keep_their_rank(spark, monkeypatch):
    """Nine of ten rows share a value; the rest meet their ranks in a join."""
    monkeypatch.setattr(ranks, "HOT", 5)
    rng = random.Random(2)
    rows = [(i, "f", 0.0 if i % 10 else round(rng.random(), 2)) for i in range(3000)] + [(i, "g", rng.choice([1.5, float("nan"), None])) for i in range(50)] + [(9, None, 1.0)]
    out = ranks.with_rank(spark.createDataFrame(rows, "i int, feature string, value double"), ["feature"], "value").toPandas()
    assert len(out) == 3000 + sum(r[1:] == ("g", 1.5) for r in rows)
    f = out[out["feature"] == "f"].sort_values("i")
    assert np.allclose(f["rank"], pd.Series([r[2] for r in rows[:3000]]).rank())
    g = out[(out["feature"] == "g") & (out["value"] == 1.5)]
    assert (g["rank"] == (len(g) + 1) / 2).all()


def _by_hand(x, y):
    p, out = x.shape[1], {}
    ry = pd.Series(y).rank()
    for i in range(p):
        for j in range(i + 1, p):
            z = x[:, i] * x[:, j]
            rho = pd.Series(z).rank().corr(ry) if len(set(z)) > 1 and len(set(y)) > 1 else 0.0
            out[i, j] = rho
    return out


@pytest.mark.parametrize("kind", ["numbers", "ties", "constant residual"])
def test_interactions_by_hand(spark, monkeypatch, kind):
    rng = np.random.default_rng(4)
    n, p = 700, 9
    x = rng.normal(size=(n, p)) if kind == "numbers" else rng.integers(-2, 3, (n, p)).astype(float)
    x[:, 3] = 1.0
    x[:, 4] = 0.0 if kind != "numbers" else x[:, 4]
    y = x[:, 0] * x[:, 1] + 0.5 * x[:, 2] * x[:, 5] + rng.normal(size=n) if kind == "numbers" else np.clip(x[:, 0] * x[:, 1] + rng.integers(-1, 2, n), -2, 2).astype(float)
    if kind == "constant residual":
        y[:] = 2.5
    monkeypatch.setattr(interactions, "ROUNDS", (8, 32))
    monkeypatch.setattr(interactions, "HELD_BYTES", 8 * 3 * 32 * 10)  # tiles of pairs, and blocks of few samples
    monkeypatch.setattr(interactions, "RANGE_ROWS", 50)
    monkeypatch.setattr(interactions, "SAMPLED", 100)
    names = [f"f{k}" for k in range(p)]
    rows = [(list(map(float, a)), float(b)) for a, b in zip(x, y, strict=True)] + [([None] + [1.0] * (p - 1), 1.0), ([float("nan")] * p, 1.0), ([1.0] * p, None)]
    table = spark.createDataFrame(rows, "x array<double>, y double").repartition(5)
    want = _by_hand(x, y)
    order = sorted(want, key=lambda k: (-round(abs(want[k]), 9), names[k[0]], names[k[1]]))
    for top in (1, 5, 100):
        got = interactions.interactions(table, names, "y", top).collect()
        assert [(r["feature1"], r["feature2"]) for r in got] == [(names[i], names[j]) for i, j in order[:top]]
        assert np.allclose([r["rho"] for r in got], [want[k] for k in order[:top]], atol=1e-9)
        assert all(r["abs_rho"] == abs(r["rho"]) for r in got)
    assert interactions.interactions(table.limit(2), names, "y").count() == 0
    assert interactions.interactions(table.limit(0), names, "y").count() == 0


def test_bounds_hold_and_drop_pairs():
    """The bounds enclose every pair's rank correlation, and leave few pairs where a few stand out."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(3000, 20)), 1)
    y = x[:, 0] * x[:, 1] + x[:, 2] * x[:, 3] + rng.normal(size=3000)
    r = pd.Series(y).rank().to_numpy() - 1500.5
    pairs = interactions.pair_indices(20)
    want = np.array([abs(v) for v in _by_hand(x, y).values()])
    for buckets in (4, 64, 1024):
        sums = np.stack([interactions.bucket_sums(x, r, p, interactions.edges(x[:500], p, buckets), buckets) for p in pairs])
        low, high = interactions.rho_bounds(sums)
        assert (low <= want + 1e-12).all() and (want <= high + 1e-12).all()
    assert (high >= np.sort(low)[-2]).sum() == 2


# bootstrap


def test_draws_are_as_many_as_clusters():
    rng = np.random.default_rng(0)
    counts = np.array([3, 0, 500, 41, 0, 0, 7, 449])
    drawn = np.concatenate([bootstrap.cluster_draws(counts, k, 4000, 5) for k in range(8)], axis=1)
    assert drawn.shape == (4000, 1000) and (drawn.sum(axis=1) == 1000).all()
    assert abs(drawn.mean(axis=0) - 1).max() < 0.1  # a standard error of 0.016
    assert abs(drawn.var() - 0.999) < 0.01
    together = np.corrcoef(drawn[:, rng.permutation(1000)[:300]].T)
    assert abs(together[np.triu_indices(300, 1)].mean() + 1 / 999) < 0.001
    assert not (bootstrap.cluster_draws(counts, 2, 50, 6) == bootstrap.cluster_draws(counts, 2, 50, 5)).all()
    assert (bootstrap.cluster_draws(np.array([1]), 0, 9, 0) == 1).all()


def _predictions(spark, n=900, hot=False):
    rng = np.random.default_rng(8)
    y = rng.integers(1, 5, n)
    c = np.round(np.clip(y + rng.normal(size=n), 1, 4), 2)
    frame = pd.DataFrame({"patient": np.where(rng.random(n) < 0.6, 0, rng.integers(0, 150, n)) if hot else rng.integers(0, 150, n), "y_true": y, "y_pred": np.clip(np.round(c), 1, 4).astype(int), "y_cont": c})
    more = pd.DataFrame({"patient": [None, 3, 3, 3], "y_true": [1, 9, 2, None], "y_pred": [1, 1, 1, 1], "y_cont": [1.0, 1.0, float("nan"), 1.0]})
    rows = [tuple(None if pd.isna(v) and k != "y_cont" else v for k, v in r.items()) for r in pd.concat([frame.astype(object), more.astype(object)]).to_dict("records")]
    return frame, spark.createDataFrame([(None if a is None else int(a), None if b is None else int(b), int(c), float(d)) for a, b, c, d in rows], "patient int, y_true int, y_pred int, y_cont double")


def _measured(frame, weight):
    y, pred, c = (frame[k].to_numpy() for k in ("y_true", "y_pred", "y_cont"))
    again = np.repeat(np.arange(len(y)), weight)
    cm = np.zeros((4, 4))
    np.add.at(cm, (y[again] - 1, pred[again] - 1), 1)
    m = thresholds.scores_of(cm)
    m["kappa_quadratic"] = m.pop("qwk")
    u, v = pd.Series(y[again]), pd.Series(c[again])
    m["spearman"] = u.rank().corr(v.rank()) if u.nunique() > 1 and v.nunique() > 1 else 0.0
    m["ccc"] = 2 * np.cov(u, v, ddof=0)[0, 1] / (u.var(ddof=0) + v.var(ddof=0) + (u.mean() - v.mean()) ** 2)
    return m


@pytest.mark.parametrize("hot", [False, True])
def test_bootstrap_by_hand(spark, monkeypatch, hot):
    """A tree of several leaves, ranges of few values, packs of few rows, a cluster of most rows: as resampled row by row."""
    for name, value in {"LEAF": 20, "RANGE_ROWS": 40, "SORTED": 100, "ROWS": 70, "BLOCK": 16}.items():
        monkeypatch.setattr(bootstrap, name, value)
    monkeypatch.setattr(ranks, "HOT", 4)
    frame, rows = _predictions(spark, hot=hot)
    got = {r["metric"]: r for r in bootstrap.intervals(rows.repartition(5), "patient", 4, resamples=60).collect()}
    drawn = draws_by_cluster(rows.where("y_true BETWEEN 1 AND 4 AND NOT isnan(y_cont)"), "patient", 60)
    w = np.array([drawn[p] for p in frame["patient"]])
    one, many = _measured(frame, np.ones(len(frame), int)), [_measured(frame, w[:, b]) for b in range(60)]
    assert set(got) == set(one) and len(one) == 9
    for name in one:
        assert abs(got[name]["estimate"] - one[name]) < 1e-9, name
        assert np.allclose([got[name]["low"], got[name]["high"]], np.percentile([m[name] for m in many], [2.5, 97.5]), atol=1e-9), name
        assert got[name]["n_resamples"] == 60
    again = {r["metric"]: tuple(r) for r in bootstrap.intervals(rows.coalesce(1), "patient", 4, resamples=60).collect()}
    assert all(np.allclose(again[name][1:], tuple(got[name])[1:], atol=1e-12) for name in got)  # the same in any partitioning


def test_bootstrap_estimate_is_that_of_the_metrics(spark):
    _, rows = _predictions(spark)
    rows = rows.where("patient IS NOT NULL AND y_true BETWEEN 1 AND 4 AND NOT isnan(y_cont)")
    got = {r["metric"]: r["estimate"] for r in bootstrap.intervals(rows, "patient", 4, resamples=5).collect()}
    want = metrics.ordinal_metrics(rows, [], 4).first()
    assert all(abs(v - want[name]) < 1e-9 for name, v in got.items())
    lone = bootstrap.intervals(rows.where("patient = 3"), "patient", 4, resamples=5).collect()
    assert len(lone) == 9 and all(r["low"] is None and r["high"] is None and r["estimate"] is not None for r in lone)
    assert bootstrap.intervals(rows.limit(0), "patient", 4, resamples=5).count() == 0


# wide matrices


@pytest.mark.parametrize("held", [1, 1 << 28])
def test_gram_by_tiles(spark, monkeypatch, held):
    """Tiles of uneven sizes, in one pass or in one for each tile; a matrix of fewer rows than columns."""
    monkeypatch.setattr(gram, "HELD_BYTES", held)
    x = np.random.default_rng(3).normal(size=(40, 53))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    tile = 20
    matrix = gram.gram(rows, 53, tile=tile)
    g = x.T @ x
    assert matrix.count() == 6 and np.allclose(gram.dense(matrix, 53, tile), g) and np.isclose(gram.trace(matrix, 53, tile), np.trace(g))
    cells = gram.cells(matrix, 53, tile).toPandas()
    assert len(cells) == 53 * 52 // 2 and np.allclose(cells["x"], g[cells["i"], cells["j"]]) and (cells["i"] < cells["j"]).all()
    q = np.random.default_rng(4).normal(size=(53, 4))
    assert np.allclose(gram.times(matrix, q, tile), g @ q)
    assert gram.gram(rows.limit(0), 53).count() == 0


@pytest.mark.parametrize("rank", [5, 150])
def test_leading_vectors_of_many_features(spark, monkeypatch, rank):
    """The block iteration finds the same values and spaces as the whole matrix, of low rank and of a slowly falling spectrum."""
    rng = np.random.default_rng(rank)
    p, k = 150, 8
    x = rng.normal(size=(400, rank)) * np.linspace(2, 0.5, rank) @ rng.normal(size=(rank, p))
    matrix = gram.gram(spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>"), p, tile=64)
    for name, value in {"DENSE": 10, "SPARE": 4, "PRODUCTS": 4}.items():
        monkeypatch.setattr(gram, name, value)
    values, vectors = gram.leading(matrix, p, k, tile=64)
    want, basis = np.linalg.eigh(x.T @ x)
    assert np.allclose(values, want[::-1][:k], rtol=1e-8, atol=1e-6 * want[-1])
    few = min(k, rank)
    assert np.allclose(np.abs((vectors[:, :few] * basis[:, ::-1][:, :few]).sum(axis=0)), 1, atol=1e-6)


def test_wide_components_equal_the_whole_matrix(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 70)) + 0.05 * rng.normal(size=(60, 70))
    long = spark.createDataFrame([(str(i), "s", f"f{j:02}", float(x[i, j])) for i in range(60) for j in range(70)], "case_id string, segment string, feature string, value double")
    whole = [t.toPandas() for t in harmonize.pca_fit(long, ["case_id", "segment"])]
    for name, value in {"DENSE": 10, "TILE": 32}.items():
        monkeypatch.setattr(gram, name, value)
    wide = [t.toPandas() for t in harmonize.pca_fit(long, ["case_id", "segment"])]
    for a, b, value in zip(whole, wide, ("weight", "cumulative"), strict=True):
        assert len(a) == len(b) and np.allclose(a[value], b[value], atol=1e-7)
    assert all(t.count() == 0 for t in harmonize.pca_fit(long.limit(0), ["case_id", "segment"]))


def test_pairwise_spearman_of_tied_values(spark, monkeypatch):
    """Features that mostly are 0: their rows meet the rank of 0 by a broadcast."""
    monkeypatch.setattr(ranks, "HOT", 20)
    monkeypatch.setattr(gram, "TILE", 3)
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (120, 7)) * (rng.random((120, 7)) < 0.3) + 0.0
    x[:, 2] = 4.0
    long = spark.createDataFrame([(str(i), "s", f"f{j}", float(x[i, j])) for i in range(120) for j in range(7)], "case_id string, segment string, feature string, value double")
    rank = pd.DataFrame(x).rank()
    got = selection.pairwise_spearman(long).collect()
    assert len(got) == 21
    for r in got:
        a, b = rank[int(r["feature1"][1:])], rank[int(r["feature2"][1:])]
        assert np.isclose(r["rho"], a.corr(b) if a.nunique() > 1 and b.nunique() > 1 else 0.0)


def test_rank_shares_of_hot_values(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HOT", 4)
    rng = random.Random(5)
    train = [("f", 0.0 if i % 10 else rng.random()) for i in range(500)] + [("g", 1.0)]
    new = [("f", v) for v in (-1.0, 0.0, 0.5, 2.0, None)] + [("f", 0.0)] * 60 + [("g", 1.0), ("h", 1.0)]
    out = harmonize.rank_share(spark.createDataFrame(train, "feature string, value double"), spark.createDataFrame(new, "feature string, value double")).collect()
    values = np.sort([v for f, v in train if f == "f"])
    assert len(out) == len(new) - 1
    for r in out:
        if r["feature"] == "f":
            want = None if r["value"] is None else (max(1, np.searchsorted(values, r["value"], side="right")) - 0.5) / len(values)
            assert r["u"] is None if want is None else np.isclose(r["u"], want)
        else:
            assert r["u"] == 0.5


# cut points


def _dense_fit(s, y, w, classes, slope):
    """Newton on the whole columns, with halved steps."""
    over = (y[:, None] > np.arange(1, classes)).astype(float)
    x = np.zeros(classes)
    x[0] = 1.0
    free = np.concatenate([[slope], np.ones(classes - 1, bool)])

    def loss(x):
        z = x[0] * s[:, None] + x[1:]
        return (w[:, None] * (np.logaddexp(0, z) - over * z)).sum()

    for _ in range(200):
        z = x[0] * s[:, None] + x[1:]
        p = 1 / (1 + np.exp(-z))
        miss, h = w[:, None] * (p - over), w[:, None] * p * (1 - p)
        g = np.concatenate([[(miss * s[:, None]).sum()], miss.sum(axis=0)])
        hess = np.diag(np.concatenate([[(h * s[:, None] ** 2).sum()], h.sum(axis=0)]))
        hess[0, 1:] = hess[1:, 0] = (h * s[:, None]).sum(axis=0)
        step = np.zeros(classes)
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], -g[free])
        while loss(x + step) > loss(x) + 1e-9 and np.abs(step).max() > 1e-13:
            step /= 2
        x = x + step
        if np.abs(step).max() < 1e-13:
            break
    return -x[1:] / x[0], x[0]


def _scores(n, seed=2):
    rng = np.random.default_rng(seed)
    s = rng.normal(0, 2, n)
    y = 1 + (1.7 * s[:, None] + rng.logistic(size=(n, 1)) > 1.7 * np.array([-2.0, 0.0, 1.5])).sum(axis=1)
    return pd.DataFrame({"id": np.arange(n), "fold": rng.integers(0, 3, n), "s": s, "y_true": y, "w": rng.uniform(0.2, 3, n)})


@pytest.mark.parametrize(("slope", "weight"), [(False, None), (True, None), (True, "w")])
def test_cut_points_equal_a_dense_solver(spark, slope, weight):
    frame = _scores(900)
    rows = spark.createDataFrame(frame).repartition(4)
    out = cutpoints.fit_thresholds(rows, ["fold"], 4, slope=slope, weight=weight).collect()
    assert len(out) == 3
    for r in out:
        part = frame[frame["fold"] == r["fold"]]
        theta, a = _dense_fit(part["s"].to_numpy(), part["y_true"].to_numpy(), part["w"].to_numpy() if weight else np.ones(len(part)), 4, slope)
        assert np.allclose(r["theta"], theta, atol=1e-8) and abs(r["slope"] - a) < 1e-8
        assert r["theta"] == sorted(r["theta"]) and r["n_rounds"] < 15
        if slope:
            assert np.allclose(theta, [-2, 0, 1.5], atol=0.6) and abs(a - 1.7) < 0.5


def test_cut_points_stop_by_the_held_out_rows(spark):
    frame = _scores(3000)
    rows = spark.createDataFrame(frame)
    (got,) = cutpoints.fit_thresholds(rows, [], 4, slope=True, held_out=0.2, by="id").collect()
    from pyspark.sql import functions as F

    kept = rows.where(F.shiftrightunsigned(F.xxhash64("id", F.lit(41)), 11) >= int(0.2 * (1 << 53))).toPandas()
    assert 0.17 < 1 - len(kept) / len(frame) < 0.23
    theta, a = _dense_fit(kept["s"].to_numpy(), kept["y_true"].to_numpy(), np.ones(len(kept)), 4, True)
    held = frame[~frame["id"].isin(kept["id"])]

    def loss(theta, a):
        z = a * (held["s"].to_numpy()[:, None] - np.array(theta))
        return (np.logaddexp(0, z) - (held["y_true"].to_numpy()[:, None] > np.arange(1, 4)) * z).sum()

    assert loss(got["theta"], got["slope"]) <= loss(theta, a) + 1e-9  # of the steps' parameters the best on held-out rows, so no worse than the last
    assert np.allclose(got["theta"], theta, atol=0.2) and abs(got["slope"] - a) < 0.3


def test_cut_points_of_odd_tables(spark):
    rows = spark.createDataFrame([("a", 0.0, 1), ("a", 1.0, 1), ("b", float("nan"), 2), ("b", None, 2), ("c", 1.0, 1), ("c", 2.0, 3), ("c", 1.5, 3), ("c", 0.5, 1), ("c", 3.0, 1), (None, 1.0, 1), ("c", 1.0, 9)], "k string, s double, y_true int")
    out = {r["k"]: r for r in cutpoints.fit_thresholds(rows, ["k"], 3, slope=True).collect()}
    assert set(out) == {"a", "c"}
    assert np.allclose(out["a"]["theta"], [0.5 + cutpoints.FAR] * 2) and out["a"]["slope"] == 1.0
    assert np.isclose(out["c"]["theta"][0], out["c"]["theta"][1], atol=1e-6)  # no row of class 2: the two bounds are one
    reverse = spark.createDataFrame([("r", -float(k), 1 + k // 10) for k in range(40)] + [("r", 5.0, 3), ("r", -39.0, 1)], "k string, s double, y_true int")
    assert cutpoints.fit_thresholds(reverse, ["k"], 4, slope=True).first()["slope"] < cutpoints.LEAST_SLOPE + 1e-6  # scores that go the wrong way
    assert cutpoints.fit_thresholds(rows.limit(0), ["k"], 3).count() == 0


# splits


def _uneven_groups(seed, groups=150):
    rng = np.random.default_rng(seed)
    sizes = rng.choice([1, 2, 3, 5, 9], groups, p=[0.3, 0.3, 0.2, 0.15, 0.05])
    taste = rng.dirichlet(np.ones(4), groups)
    return [(f"g{g}", int(y)) for g, n in enumerate(sizes) for y in rng.choice(4, n, p=taste[g]) + 1]


def test_stratified_split_is_no_worse_than_greedy(spark):
    """Ten seeded tables: the cost against a pass group by group, the most uneven first, written out here."""
    ratios = []
    for seed in range(10):
        rows = _uneven_groups(seed)
        found = {r["g"]: r["fold"] for r in splits.stratified_group_kfold(spark.createDataFrame(rows, "g string, y int"), "g", "y", 4, 5, seed).collect()}
        table = pd.DataFrame(rows, columns=["g", "y"]).groupby(["g", "y"]).size().unstack(fill_value=0)
        total = table.to_numpy().sum(axis=0)
        assert set(found) == set(table.index) and set(found.values()) == set(range(5))
        cost = lambda state: ((state / total - 0.2) ** 2).sum()  # noqa: B023, E731
        mine = cost(np.stack([table[[found[g] == f for g in table.index]].to_numpy().sum(axis=0) for f in range(5)]))
        state = np.zeros((5, 4))
        for row in sorted(table.to_numpy().tolist(), key=lambda r: -np.std(r)):
            grown = [cost(np.where(np.arange(5)[:, None] == f, state + row, state)) for f in range(5)]
            state[int(np.argmin(grown))] += row
        ratios.append(mine / cost(state))
    assert max(ratios) <= 1 + 1e-9, ratios


def test_polished_split_has_no_better_neighbour():
    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 6, (12, 3)).astype(float)
    counts = rng.integers(1, 9, 12)
    total = (vectors * counts[:, None]).sum(axis=0)
    cost = lambda state: ((state / total - 1 / 3) ** 2).sum(axis=1)
    start, first = splits._greedy(vectors, counts, 3, cost, np.arange(12))
    given, last = splits._polished(vectors, start, cost)
    assert (given.sum(axis=1) == counts).all() and (given >= 0).all() and last <= first
    for i in range(12):
        for f in range(3):
            for g in range(3):
                if given[i, f]:
                    moved = given.copy()
                    moved[i, f] -= 1
                    moved[i, g] += 1
                    assert cost(moved.T @ vectors).sum() >= last - 1e-12
                    for j in range(12):
                        if moved[j, g] and j != i:
                            turned = moved.copy()
                            turned[j, g] -= 1
                            turned[j, f] += 1
                            assert cost(turned.T @ vectors).sum() >= last - 1e-12


def test_groups_are_numbered_across_hash_ranges(spark):
    rows = spark.createDataFrame([(f"p{k}", "m" if k % 7 else None) for k in range(3000)], "p string, scanner string")
    out = splits._numbered(rows, "p", ["scanner"], 5).toPandas()
    for _, part in out.groupby("scanner", dropna=False):
        assert sorted(part["__i"]) == list(range(len(part)))


def test_groups_without_scanner_get_a_fold(spark):
    rows = spark.createDataFrame([(f"g{k // 2}", 1 + k % 4, "m" if k % 6 < 4 else None) for k in range(60)], "g string, y int, scanner string")
    assert splits.balanced_split(rows, "g", "y", "scanner", 4, 3, trials=4).count() == 30
    assert splits.stratified_group_kfold(rows.limit(0), "g", "y", 4, 3).count() == 0


# images and curves


def _flooded(mask):
    """Components by flood fill, in reading order."""
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        out[y, x] = n
        while todo:
            a, b = todo.pop()
            for i in range(max(a - 1, 0), min(a + 2, mask.shape[0])):
                for j in range(max(b - 1, 0), min(b + 2, mask.shape[1])):
                    if mask[i, j] and not out[i, j]:
                        out[i, j] = n
                        todo.append((i, j))
    return out


@pytest.mark.parametrize("share", [0.0, 0.1, 0.35, 0.5, 0.9, 1.0])
def test_components_equal_a_flood_fill(share):
    rng = np.random.default_rng(int(share * 10))
    for shape in ((1, 1), (1, 30), (30, 1), (17, 23), (40, 40)):
        mask = rng.random(shape) < share
        assert (voxels.components8(mask) == _flooded(mask)).all()


def test_components_of_long_paths():
    spiral, comb = np.zeros((41, 41), bool), np.zeros((20, 61), bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = True
        spiral[k + 2 : 41 - k, k] = True
    comb[:, ::2] = True
    comb[-1] = True
    for mask in (spiral, spiral.T, comb, comb[::-1], np.eye(33, dtype=bool), np.indices((20, 20)).sum(axis=0) % 2 == 0):
        assert (voxels.components8(mask) == _flooded(mask)).all()


def test_mixture_peaks_equal_the_fit_on_pixels(spark):
    """Regions of many partitions, of distinct and of repeated intensities, of one value and with nulls."""
    rng = np.random.default_rng(7)
    regions = {1: np.concatenate([rng.normal(100, 9, 3000), rng.normal(160, 14, 2000)]), 2: rng.integers(0, 40, 900).astype(float), 3: np.full(20, 5.0), 4: rng.normal(0, 1, 7) + 1e6}
    rows = [(case, 0, 7, float(v)) for case, x in regions.items() for v in x] + [(1, 0, 7, None), (1, 0, 8, 3.0)]
    random.Random(1).shuffle(rows)
    out = {r["case_id"]: r for r in voxels.mixture_peaks(spark.createDataFrame(rows, "case_id long, z int, label int, intensity double").repartition(6), [7]).collect()}
    assert set(out) == set(regions)
    for case, x in regions.items():
        mean, sd, _ = numeric.two_gaussians(x)
        scale = max(1.0, np.ptp(x))
        assert np.allclose([out[case]["low"], out[case]["high"]], mean, rtol=0, atol=1e-6 * scale)
        assert np.isclose(out[case]["index"], (mean[1] - mean[0]) / (sd.sum() + 1e-8), rtol=1e-5)


def test_partial_dependence_by_hand(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 10)  # ranges
    rng = np.random.default_rng(5)
    x, by = rng.normal(size=(300, 3)), rng.integers(0, 2, 300)
    x[by == 0, 1] = rng.integers(0, 4, (by == 0).sum())
    rows = spark.createDataFrame([(int(b), v.tolist()) for b, v in zip(by, x, strict=True)] + [(0, [None, None, 1.0])], "b int, x array<double>")
    got = explanation.partial_dependence(rows, 1, [1.0, -2.0, 0.5], 3.0, "b", 9).collect()
    for b in (0, 1):
        values = x[by == b, 1]
        grid = np.unique(values) if b == 0 else np.quantile(values, np.arange(9) / 8)
        mine = sorted((r["x"], r["effect"]) for r in got if r["b"] == b)
        assert np.allclose([m[0] for m in mine], grid) and np.allclose([m[1] for m in mine], -2.0 * (grid - np.median(values)))


def test_redundancy_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(gram, "TILE", 4)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(90, 5))
    x = np.concatenate([base, base[:, :3] + 0.05 * rng.normal(size=(90, 3)), -base[:, 1:2], np.ones((90, 1))], axis=1)
    long = spark.createDataFrame([(str(i), "s", f"f{j}", float(x[i, j])) for i in range(90) for j in range(10)], "case_id string, segment string, feature string, value double")
    scores = spark.createDataFrame([(f"f{j}", float(j % 4)) for j in range(10)], "feature string, score double")
    whole = selection.deduplicate(selection.pairwise_spearman(long), scores, 0.9).orderBy("feature").collect()
    near, extremes = selection.redundancy(long, 0.9)
    assert near.count() == 5  # three near copies, one turned round and its copy
    got = selection.deduplicate(near, scores, 0.9, extremes).orderBy("feature").collect()
    for a, b in zip(whole, got, strict=True):
        assert a[:4] == b[:4] and a["removed_order"] == b["removed_order"] and a["n_over"] == b["n_over"] and np.isclose(a["max_abs_rho"], b["max_abs_rho"])
    one, most = selection.redundancy(long.where("feature = 'f0'"), 0.9)
    assert one.count() == 0 and most.count() == 0
    assert all(t.count() == 0 for t in selection.redundancy(long.limit(0)))


# file trees


def test_file_trees_are_paired(spark, tmp_path):
    """A thousand files in nested folders: suffixes and marks in all forms, files that have no partner, other files, blanks in names."""
    rng = random.Random(3)
    want = set()
    for k in range(400):
        folder = rng.choice(["", "a", "a/b", "c d", "a/b/c"])
        image = f"case{k}{rng.choice(['.nii.gz', '.nii', '.mha', '.x.nrrd', '.dcm'])}"
        mask = f"{rng.choice(['case{}_mask', 'case{}-seg', 'case{}', 'case{}_seg-mask', 'case{}_SEG', 'other{}']).format(k)}{rng.choice(['.nii.gz', '.mhd'])}"
        for root, name in (("images", image), ("masks", mask), ("images", f"note{k}.txt")):
            at = tmp_path / root / folder
            at.mkdir(parents=True, exist_ok=True)
            (at / name).write_bytes(b"x" * (1 + k % 5))
        if mask.split(".")[0] in {f"case{k}", f"case{k}_mask", f"case{k}-seg", f"case{k}_seg-mask"}:
            dot = f"{folder}/" if folder else ""
            want.add((f"case{k}", folder, dot + image, dot + mask))
    assert 200 < len(want) < 300
    assert {tuple(r) for r in tables.pair_folders(spark, str(tmp_path / "images"), f"file://{tmp_path}/masks/").collect()} == want
    every = tables.list_files(spark, str(tmp_path / "images"))
    assert every.count() == 800 and every.where("path LIKE 'note%' OR path LIKE '%/note%'").agg({"length": "sum"}).first()[0] == 3 * 400
    assert "content" not in every._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    (tmp_path / "masks" / "a" / "case_z_mask.nii").write_bytes(b"x")
    (tmp_path / "masks" / "a" / "case_z.nii").write_bytes(b"x")
    (tmp_path / "images" / "a" / "case_z.nii").write_bytes(b"x")
    (pair,) = tables.pair_folders(spark, str(tmp_path / "images"), str(tmp_path / "masks")).where("case_id = 'case_z'").collect()
    assert pair["mask"] == "a/case_z_mask.nii"  # the last path
    (tmp_path / "images" / "empty.nii").write_bytes(b"")
    assert tables.list_files(spark, str(tmp_path / "images"), [".nii"]).where("path = 'empty.nii'").count() == 0


def test_fold_files_are_listed(spark, tmp_path):
    for at in ("fold_0", "run/fold_12", "fold_x", "notfold_3", "run/fold_2/deeper"):
        (tmp_path / at).mkdir(parents=True, exist_ok=True)
        (tmp_path / at / "val_predictions.csv").write_text("a\n1\n")
        (tmp_path / at / "train_predictions.csv").write_text("a\n1\n")
    assert {tuple(r) for r in tables.list_folds(spark, str(tmp_path)).collect()} == {(0, "fold_0/val_predictions.csv"), (12, "run/fold_12/val_predictions.csv"), (2, "run/fold_2/deeper/val_predictions.csv")}


# slices


def test_slices_equal_voxel_jobs(spark):
    """Random images of two discs that touch: growth, shrinking, shifts, edges and boxes by arrays as by joins of neighbours."""
    rng = np.random.default_rng(2)
    h, w = 9, 12
    rows = [(c, z, y, x, float(np.round(rng.normal(100, 20), 3)), int(rng.choice([0, 7, 7, 7, 9, 9, 20]))) for c in range(3) for z in range(2) for y in range(h) for x in range(w)]
    vox = spark.createDataFrame(rows, "case_id long, z int, y int, x int, intensity double, label int")
    held = slices.to_slices(vox.repartition(4), h, w)
    plain = lambda df, *more: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select("case_id", "z", "y", "x", "intensity", "label", *more).collect())
    assert plain(slices.to_voxels(held)) == plain(vox)
    for radius in (1, 2):
        assert plain(slices.to_voxels(slices.dilate(held, [7, 9], radius))) == plain(voxels.dilate(vox, [7, 9], radius))
        assert plain(slices.to_voxels(slices.erode(held, [7, 9], radius))) == plain(voxels.erode(vox, [7, 9], radius))
    for shift in ((2, -3), (0, 0), (-9, 1), (20, 20)):
        assert plain(slices.to_voxels(slices.translate(held, *shift))) == plain(voxels.translate(vox, *shift, h, w))
    assert plain(slices.to_voxels(slices.gradients(held), "magnitude", "direction"), "magnitude", "direction") == plain(voxels.gradients(vox), "magnitude", "direction")
    boxes = {tuple(r) for r in slices.box_counts(held, 110.0, most=8).collect()}
    assert boxes == {tuple(r) for r in voxels.box_counts(vox.where("intensity > 110"), ["case_id", "z"], h, w, most=8).select("case_id", "z", "box", "n").collect()}


def test_slices_with_gaps_and_strays(spark):
    rows = [(1, 0, 0, 0, 5.0, 7), (1, 0, 1, 1, 6.0, 0), (1, 0, 9, 9, 1.0, 7), (1, 0, -1, 0, 1.0, 7), (1, 0, 1, 1, 7.0, 0)]
    vox = spark.createDataFrame(rows, "case_id long, z int, y int, x int, intensity double, label int")
    held = slices.to_slices(vox, 2, 2)
    assert {tuple(r) for r in slices.to_voxels(held).collect()} == {(1, 0, 0, 0, 5.0, 7), (1, 0, 1, 1, 7.0, 0)}
    assert {tuple(r)[2:4] + (r["label"],) for r in slices.to_voxels(slices.dilate(held, [7])).collect()} == {(0, 0, 7), (1, 1, 7)}  # absent places stay absent
    assert slices.to_slices(vox.limit(0), 2, 2).count() == 0
