"""Work that follows the input: many small groups in a call, bounded frames, one pass where there were more."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradeloom import plans
from gradeloom.functions import numeric
from gradeloom.operators import harmonize, ranks, reshape, runs, selection, slices, voxels


def test_whole_groups_of_any_batches():
    """A group that lies across batches comes whole and once, nulls in a key are one group, and no batch waits but for its last group."""
    frame = pd.DataFrame({"a": [1.0, 1, 1, 2, 2, None, None, None, 3], "b": list("xxyyyyyzz"), "v": range(9)})
    keys = ["a", "b"]
    want = [[0, 1], [2], [3, 4], [5, 6], [7], [8]]
    for size in range(1, 10):
        got, most = [], 0
        for part in runs.whole((frame.iloc[i : i + size] for i in range(0, 9, size)), keys):
            at = runs.starts(part, keys)
            got += [list(g) for g in np.split(part["v"].to_numpy(), at[1:])]
            most = max(most, len(part))
        assert [[int(v) for v in g] for g in got] == want and most <= size + 2
    assert not list(runs.whole(iter([frame.iloc[:0]]), keys))


def test_regions_are_fitted_many_at_once(spark, monkeypatch):
    """Regions in few calls, each with the fit that it has alone."""
    rng = np.random.default_rng(2)
    calls = spark.sparkContext.accumulator(0)
    rows = [(case, 0, 0, k, float(v), 7) for case in range(300) for k, v in enumerate(rng.normal(100, 9, 1 + case % 23) + 40 * (rng.random(1 + case % 23) < 0.4))]
    vox = spark.createDataFrame(rows, "case_id long, z int, y int, x int, intensity double, label int")
    want = {case: numeric.two_gaussians(np.array([r[4] for r in rows if r[0] == case])) for case in range(300)}
    fit = voxels.gaussian_pairs

    def counted(*args):
        calls.add(1)
        return fit(*args)

    monkeypatch.setattr(voxels, "gaussian_pairs", counted)
    got = {r["case_id"]: r for r in voxels.mixture_peaks(vox, [7]).collect()}
    assert len(got) == 300 and calls.value <= 20
    for case, (mean, sd, _) in want.items():
        assert np.allclose([got[case]["low"], got[case]["high"], got[case]["index"]], [*mean, (mean[1] - mean[0]) / (sd.sum() + 1e-8)], rtol=1e-4)


def test_slices_are_worked_on_in_bounded_stacks(spark, monkeypatch):
    """Slices go through the work some at a time, no more than HELD pixels; what comes out is each slice's own."""
    rng = np.random.default_rng(4)
    calls, most = spark.sparkContext.accumulator(0), 16 * 20
    frame = pd.DataFrame([(c, z, y, x, float(rng.integers(99)), int(rng.integers(1, 4))) for c in range(200) for z in range(2) for y in range(4) for x in range(4) if rng.random() < 0.8], columns=["case_id", "z", "y", "x", "intensity", "label"])
    again = frame.iloc[::7].assign(intensity=lambda f: f["intensity"] - 1)  # two at a place: the larger label and intensity stays
    vox = spark.createDataFrame(pd.concat([again, frame, again.assign(y=-1)]), "case_id long, z int, y int, x int, intensity double, label int").repartition(3)
    shifted = slices._shifted

    def counted(image, dy, dx, fill):
        assert image.size <= most and image.shape[-2:] == (4, 4)
        calls.add(1)
        return shifted(image, dy, dx, fill)

    monkeypatch.setattr(slices, "HELD", most)
    monkeypatch.setattr(slices, "_shifted", counted)
    moved = {tuple(r) for r in slices.to_voxels(slices.translate(slices.to_slices(vox, 4, 4), 1, -2)).collect()}
    want = frame.assign(y=frame["y"] + 1, x=frame["x"] - 2)
    assert moved == set(want[want["y"].between(0, 3) & want["x"].between(0, 3)].itertuples(index=False, name=None))
    assert calls.value <= 2 * (400 // 20 + 16)


def test_directions_are_summed_up_in_one_pass(spark):
    """Gradients are made once for all statistics; null directions are a bin."""
    angles = [-np.pi, -3.0, 0.0, 0.1, 3.1, np.pi, None, None]
    rows = spark.createDataFrame([(1, 0, 7, float(i), a) for i, a in enumerate(angles)], "case_id long, z int, label int, magnitude double, direction double")
    out = voxels.direction_statistics(rows, [7])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    bins = pd.Series([36 if a is None else min(35, int((a + np.pi) / (2 * np.pi) * 36)) for a in angles]).value_counts(normalize=True)
    assert np.isclose(out.first()["entropy"], -(bins * np.log2(bins)).sum())


def test_samples_are_projected_without_a_row_for_each_weight(spark):
    """No row a value and component: a value adds to the sums of all components; nulls, absent features and absent weights as in the plain join."""
    rng = np.random.default_rng(5)
    rows = [(str(i), f"f{j}", float(rng.normal()) if rng.random() < 0.8 else None) for i in range(40) for j in range(6) if rng.random() < 0.7]
    long = spark.createDataFrame([*rows, ("none", "f1", None), ("other", "f9", 1.0), ("last", "f5", 2.0)], "case_id string, feature string, value double")
    fitted = spark.createDataFrame([(f"f{j}", j / 3, 1.0 + j) for j in range(6)], "feature string, mean double, sd double")
    for some in (range(6), range(5)):  # of component 2, all features or not the last
        loadings = spark.createDataFrame([(f"f{j}", c, float(rng.normal())) for c in range(3) for j in (some if c == 2 else range(6))], "feature string, component int, weight double")
        out = harmonize.pca_apply(long, ["case_id"], fitted, loadings)
        plain = harmonize.zscore_apply(long, fitted).join(loadings, "feature").groupBy("case_id", F.concat(F.lit("PC_"), F.col("component").cast("string")).alias("feature")).agg(F.sum(F.col("value") * F.col("weight")).alias("value"))
        got, want = ({(r["case_id"], r["feature"]): r["value"] for r in t.collect()} for t in (out, plain))
        assert got.keys() == want.keys() and all(want[k] is None if v is None else np.isclose(v, want[k]) for k, v in got.items())
        assert ("none", "PC_0") in got and got["none", "PC_0"] is None and (("last", "PC_2") in got) == (len(some) == 6)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate inline") < plan.index("Aggregate")  # rows of components are made of the sums


def test_rows_meet_a_table_of_few_values_in_one_pass(spark, monkeypatch):
    """Up to WHOLE distinct values are broadcast, and the rows are read once; beyond, frequent values and a join give the same."""
    long = spark.createDataFrame([("f" if i % 3 else "g", i % 5, None if i % 50 == 7 else float(0 if i % 4 else i % 97)) for i in range(600)], "feature string, fold int, value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {}
        for whole in (ranks.WHOLE, 0):
            monkeypatch.setattr(ranks, "WHOLE", whole)
            for name, out in (("gauss", harmonize.rank_gauss(long.where("fold <> 0"), long)), ("share", harmonize.rank_share(long.where("fold <> 0"), long)), ("rank", ranks.with_rank(long, ["feature"], "value"))):
                plan = out._jdf.queryExecution().executedPlan().toString()
                assert ("LeftAnti" in plan) == (whole == 0)
                got.setdefault(name, []).append(sorted(map(str, out.collect())))
        assert all(a == b and len(a) >= 588 for a, b in got.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_audit_tests_its_features_once(spark, sf_dir, monkeypatch):
    """Rank correlations with the grade are made once for tests and scores, and no join deals rows by feature alone."""
    calls, found = [], selection.spearman_with
    monkeypatch.setattr(selection, "spearman_with", lambda *args: calls.append(1) or found(*args))
    assert plans.QUERIES["f16_feature_audit"](spark, sf_dir).count() == 64 and len(calls) == 1
    long = spark.createDataFrame([(str(i), "s", c, f"f{j}", float(i * j)) for i in range(9) for j in range(2) for c in ("gold", "other")], "case_id string, segment string, condition string, feature string, value double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = selection.icc21(long)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") >= 2  # the first is of rows a feature
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_levels_are_cut_out_of_wide_rows_read_once(spark):
    wide = spark.createDataFrame([("1", 5, 1.0, 2, 3.0), ("2", 6, None, 4, None)], "case_id string, age int, `Deep_L1-L2_0` double, `Deep_L1-L2_1` int, `Deep_L2-L3_0` double")
    wide = wide.groupBy("case_id").agg(*[F.first(F.col(f"`{c}`")).alias(c) for c in wide.columns[1:]])
    out = reshape.export_by_level(wide, "case_id")
    assert out.columns == ["Sample_ID", "Disc_Level", "age", "Deep_0", "Deep_1"]
    assert {tuple(r) for r in out.collect()} == {("1", "L1-L2", 5, 1.0, 2), ("1", "L2-L3", 5, 3.0, None), ("2", "L1-L2", 6, None, 4), ("2", "L2-L3", 6, None, None)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
