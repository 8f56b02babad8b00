"""Statistics and transforms of voxel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import slices, voxels
from . import inputs
from .inputs import VOXELS
from .registry import ORACLES, query, r6

SPACING = (4.0, 0.7, 0.7)


@query(f"WITH {VOXELS} SELECT case_id, z, count(*) AS n FROM vox JOIN (SELECT case_id AS c, max(z) + 1 AS s FROM vox GROUP BY 1) ON c = case_id WHERE z >= greatest(0, s // 2 - 1) AND z < greatest(0, s // 2 - 1) + 2 GROUP BY ALL")
def i01_middle_slices(spark, sf_dir) -> DataFrame:
    return voxels.middle_slices(inputs.voxels(spark, sf_dir), 2).groupBy("case_id", "z").agg(F.count(F.lit(1)).alias("n"))


_EXTENT = "ext AS (SELECT case_id, label, (max(z) - min(z) + 1) * 4.0 AS dz, (max(y) - min(y) + 1) * 0.7 AS dy, (max(x) - min(x) + 1) * 0.7 AS dx FROM vox WHERE label = 7 AND intensity > 95 GROUP BY ALL)"


@query(f"WITH {VOXELS}, {_EXTENT} SELECT " + ", ".join(f"CAST(ceil(ceil((quantile_cont(d{c}, 0.98) + 6.0) / {s}) / 8) * 8 AS INTEGER) AS n{c}" for c, s in zip("zyx", SPACING, strict=True)) + " FROM ext")
def i02_roi_size(spark, sf_dir) -> DataFrame:
    return voxels.roi_size(voxels.extents(inputs.voxels(spark, sf_dir).where("intensity > 95"), SPACING, [7]), SPACING)


_STATS = "st AS (SELECT case_id, z, label, count(*) AS n, avg(intensity) AS mean, stddev_pop(intensity) AS sd, min(intensity) AS low, max(intensity) AS high, median(intensity) AS median FROM vox WHERE label IN (7, 20) GROUP BY ALL), mo AS (SELECT case_id, z, label, avg(power(intensity - mean, 2)) AS m2, avg(power(intensity - mean, 3)) AS m3, avg(power(intensity - mean, 4)) AS m4 FROM vox JOIN st USING (case_id, z, label) GROUP BY ALL)"


@query(f"WITH {VOXELS}, {_STATS} SELECT case_id, z, label, n, {r6('mean', 'mean')}, {r6('sd', 'sd')}, {r6('sd / mean', 'cv')}, {r6('low', 'low')}, {r6('high', 'high')}, {r6('median', 'median')}, {r6('m3 / power(m2 + 1e-8, 1.5)', 'skew')}, {r6('m4 / power(m2 + 1e-8, 2) - 3', 'kurtosis')} FROM st JOIN mo USING (case_id, z, label)")
def i03_roi_statistics(spark, sf_dir) -> DataFrame:
    return voxels.roi_statistics(inputs.voxels(spark, sf_dir), [7, 20])


_PURE = "(SELECT case_id, z, label, CASE WHEN count(*) > 20 AND count(*) FILTER (intensity > q) > 10 THEN avg(intensity) FILTER (intensity > q) ELSE avg(intensity) END AS signal FROM vox JOIN (SELECT case_id, z, label, quantile_cont(intensity, 0.25) AS q FROM vox GROUP BY ALL) USING (case_id, z, label) GROUP BY ALL)"


@query(f"WITH {VOXELS}, p AS {_PURE}, a AS (SELECT case_id, z, label, signal FROM p WHERE label = 7), b AS (SELECT case_id, z, signal AS reference FROM p WHERE label = 20) SELECT case_id, z, label, {r6('signal', 'signal')}, {r6('reference', 'reference')}, {r6('signal / reference', 'si_ratio')} FROM a JOIN b USING (case_id, z)")
def i04_signal_ratio(spark, sf_dir) -> DataFrame:
    return voxels.signal_ratio(inputs.voxels(spark, sf_dir), [7])


_SI = f"{_STATS}, p AS {_PURE}, si AS (SELECT a.case_id, a.z, a.label, a.signal / b.signal AS ratio FROM p a JOIN p b ON a.case_id = b.case_id AND a.z = b.z AND a.label = 7 AND b.label = 20), sm AS (SELECT st.*, CASE WHEN m2 < 1e-8 THEN 0 ELSE m3 / power(m2 + 1e-8, 1.5) END AS skew, CASE WHEN m2 < 1e-8 THEN 0 ELSE m4 / power(m2 + 1e-8, 2) - 3 END AS kurtosis FROM st JOIN mo USING (case_id, z, label))"


@query(f"WITH {VOXELS}, {_SI} SELECT case_id, z, label, {r6('ratio', 'hydration')}, {r6('sd / (mean + 1e-8)', 'heterogeneity')}, {r6('0.6 * ratio + 0.4 / (sd / (mean + 1e-8) + 1e-8)', 'nucleus_activity')}, {r6('0.5 * (1 - least(ratio, 1)) + 0.3 * greatest(skew, 0) + 0.2 * (1 - least(abs(kurtosis), 1))', 'rapid_degeneration')} FROM sm JOIN si USING (case_id, z, label)")
def i03_signal_indices(spark, sf_dir) -> DataFrame:
    vox = inputs.voxels(spark, sf_dir)
    stats = voxels.roi_statistics(vox, [7]).join(voxels.signal_ratio(vox, [7]).select(*voxels.REGION, "si_ratio"), voxels.REGION)
    return voxels.signal_indices(stats).select(*voxels.REGION, "hydration", "heterogeneity", "nucleus_activity", "rapid_degeneration")


@query()
def i06_mixture_peaks(spark, sf_dir) -> DataFrame:
    return voxels.mixture_peaks(inputs.voxels(spark, sf_dir), [7])


_BOX = "bx AS (SELECT case_id, z, b AS box, count(DISTINCT (y // b) * 100 + x // b) AS n FROM vox, (SELECT unnest([1, 2]) AS b) WHERE intensity > 110 GROUP BY ALL)"


@query(f"WITH {VOXELS}, {_BOX} SELECT case_id, z, CAST(box AS INTEGER) AS box, n FROM bx")
def i07_box_counts(spark, sf_dir) -> DataFrame:
    return voxels.box_counts(inputs.voxels(spark, sf_dir).where("intensity > 110"), ["case_id", "z"], 8, 8)


@query(f"WITH {VOXELS}, {_BOX.replace('[1, 2]', '[1, 2, 4]')} SELECT case_id, z, {r6('-regr_slope(ln(n), ln(box))', 'fd')}, {r6('regr_r2(ln(n), ln(box))', 'r_squared')} FROM bx GROUP BY ALL")
def i07_fractal_dimension(spark, sf_dir) -> DataFrame:
    edges = inputs.voxels(spark, sf_dir).where("intensity > 110")
    return voxels.fractal_dimension(voxels.box_counts(edges, ["case_id", "z"], 8, 8, most=4), ["case_id", "z"])


_MOMENTS = """k AS (SELECT * FROM vox WHERE label = 7 AND intensity > 100), c AS (SELECT case_id, z, CAST(count(*) AS DOUBLE) AS area, avg(x) AS cx, avg(y) AS cy FROM k GROUP BY ALL),
m AS (SELECT case_id, z, any_value(area) AS area, sum((x - cx) * (x - cx)) / power(any_value(area), 2) AS n20, sum((y - cy) * (y - cy)) / power(any_value(area), 2) AS n02, sum((x - cx) * (y - cy)) / power(any_value(area), 2) AS n11,
 sum(power(x - cx, 3)) / power(any_value(area), 2.5) AS n30, sum(power(y - cy, 3)) / power(any_value(area), 2.5) AS n03, sum((x - cx) * (x - cx) * (y - cy)) / power(any_value(area), 2.5) AS n21, sum((x - cx) * (y - cy) * (y - cy)) / power(any_value(area), 2.5) AS n12 FROM k JOIN c USING (case_id, z) GROUP BY ALL)"""


@query(f"""WITH {VOXELS}, {_MOMENTS}
SELECT case_id, z, {r6('area', 'area')}, {r6('n20 + n02', 'hu1')}, {r6('power(n20 - n02, 2) + 4 * n11 * n11', 'hu2')}, {r6('power(n30 - 3 * n12, 2) + power(3 * n21 - n03, 2)', 'hu3')}, {r6('power(n30 + n12, 2) + power(n21 + n03, 2)', 'hu4')} FROM m""")
def i08_hu_moments(spark, sf_dir) -> DataFrame:
    mask = inputs.voxels(spark, sf_dir).where("label = 7 AND intensity > 100")
    return voxels.hu_moments(mask, ["case_id", "z"]).select("case_id", "z", "area", "hu1", "hu2", "hu3", "hu4")


_HU = {
    1: "n20 + n02",
    2: "power(n20 - n02, 2) + 4 * n11 * n11",
    3: "power(n30 - 3 * n12, 2) + power(3 * n21 - n03, 2)",
    4: "power(n30 + n12, 2) + power(n21 + n03, 2)",
    5: "(n30 - 3 * n12) * (n30 + n12) * (power(n30 + n12, 2) - 3 * power(n21 + n03, 2)) + (3 * n21 - n03) * (n21 + n03) * (3 * power(n30 + n12, 2) - power(n21 + n03, 2))",
    6: "(n20 - n02) * (power(n30 + n12, 2) - power(n21 + n03, 2)) + 4 * n11 * (n30 + n12) * (n21 + n03)",
    7: "(3 * n21 - n03) * (n30 + n12) * (power(n30 + n12, 2) - 3 * power(n21 + n03, 2)) - (n30 - 3 * n12) * (n21 + n03) * (3 * power(n30 + n12, 2) - power(n21 + n03, 2))",
}


@query(f"WITH {VOXELS}, {_MOMENTS}, h AS (SELECT case_id, z, area, {', '.join(f'{v} AS hu{i}' for i, v in _HU.items())} FROM m) SELECT case_id, z, {r6('area', 'area')}, {', '.join(r6(f'hu{i}', f'hu{i}') for i in _HU)}, {', '.join(r6(f'CASE WHEN abs(hu{i}) < 1e-30 THEN 0 ELSE -sign(hu{i}) * log10(abs(hu{i})) END', f'log{i}') for i in _HU)} FROM h")
def i08_hu_moments_all(spark, sf_dir) -> DataFrame:
    return voxels.hu_moments(inputs.voxels(spark, sf_dir).where("label = 7 AND intensity > 100"), ["case_id", "z"])


@query()
def i09_bright_spots(spark, sf_dir) -> DataFrame:
    return voxels.bright_spots(inputs.voxels(spark, sf_dir), [7], factor=1.05)


_PLATES = "v AS (SELECT *, avg(intensity) OVER w AS ref, min(y) OVER w AS t, max(y) OVER w AS b FROM vox WHERE label = 7 WINDOW w AS (PARTITION BY case_id, z)), pl AS (SELECT case_id, z, 'upper' AS plate, intensity, ref FROM v WHERE y < t + 1 UNION ALL SELECT case_id, z, 'lower', intensity, ref FROM v WHERE y >= b - 1), ab AS (SELECT case_id, z, plate, count(*) AS n, avg(intensity) AS mean, stddev_pop(intensity) AS sd, any_value(ref) AS ref FROM pl WHERE intensity > ref * 1.15 OR intensity < ref * 0.85 GROUP BY ALL), ty AS (SELECT case_id, z, plate, n, mean, sd, CASE WHEN mean > ref * 1.15 AND sd / mean > 0.25 THEN 1 WHEN mean > ref * 1.15 THEN 2 WHEN mean < ref * 0.85 THEN 3 ELSE 0 END AS type, CASE WHEN mean > ref * 1.15 AND sd / mean > 0.25 THEN 0.9 WHEN mean > ref * 1.15 THEN 0.5 WHEN mean < ref * 0.85 THEN 0.6 ELSE 0.0 END AS severity FROM ab)"


@query(f"WITH {VOXELS}, {_PLATES} SELECT case_id, z, plate, n, {r6('mean', 'mean')}, {r6('sd', 'sd')}, type, {r6('severity', 'severity')} FROM ty")
def i10_endplate_changes(spark, sf_dir) -> DataFrame:
    return voxels.endplate_changes(inputs.voxels(spark, sf_dir), 7)


@query(f"WITH {VOXELS}, {_PLATES}, s AS (SELECT case_id, count(*) AS regions, avg(CAST(type = 1 AS INTEGER)) AS a, avg(CAST(type = 3 AS INTEGER)) AS c, avg(CAST(severity AS DOUBLE)) AS m, stddev_pop(CAST(severity AS DOUBLE)) AS d FROM ty GROUP BY case_id) SELECT case_id, regions, {r6('a', 'share1')}, {r6('0.3 * least(regions / 10.0, 1) + 0.4 * a + 0.3 * m', 'risk')}, {r6('a * m', 'activity')}, {r6('0.4 * c + 0.3 * greatest(0, least(1, 1 - d)) + 0.3 * greatest(0, least(1, 1 - m))', 'stability')} FROM s")
def i10_endplate_summary(spark, sf_dir) -> DataFrame:
    return voxels.endplate_summary(voxels.endplate_changes(inputs.voxels(spark, sf_dir), 7), ["case_id"])


@query(f"""WITH {VOXELS}, t AS (SELECT case_id, z, avg(intensity) AS m, stddev_pop(intensity) AS s, min(intensity) AS l, max(intensity) AS h, median(intensity) AS md, quantile_cont(intensity, 0.75) - quantile_cont(intensity, 0.25) AS i FROM vox GROUP BY ALL)
SELECT case_id, z, y, x, {r6('(intensity - m) / s', 'z_score')}, {r6('(intensity - md) / (i / 1.349)', 'robust')}, {r6('(greatest(0.5, least(255.5, intensity)) - 0.5) / 255 * 255', 'window')}, CAST(least(greatest(1, ceil((h - l) / 16)) - 1, floor((intensity - l) / 16)) AS INTEGER) AS level, CAST(intensity > m AS INTEGER) AS bit FROM vox JOIN t USING (case_id, z)""")
def i11_intensity(spark, sf_dir) -> DataFrame:
    keys = ["case_id", "z"]
    rows = voxels.normalize(inputs.voxels(spark, sf_dir), keys, robust=True).withColumnRenamed("z_score", "robust")
    rows = voxels.binarize(voxels.discretize(voxels.normalize(rows, keys), keys), keys)
    return rows.select("case_id", "z", "y", "x", "z_score", "robust", voxels.window_level(F.col("intensity")).alias("window"), "level", "bit")


@query(f"WITH {VOXELS}, t AS (SELECT case_id, z, quantile_cont(intensity, 0.01) AS l, quantile_cont(intensity, 0.99) AS h FROM vox GROUP BY ALL) SELECT case_id, z, CAST(sum(floor(round((greatest(l, least(h, intensity)) - l) / (h - l) * 255, 9))) AS BIGINT) AS total FROM vox JOIN t USING (case_id, z) GROUP BY ALL")
def i11_to_8bit(spark, sf_dir) -> DataFrame:
    return voxels.to_8bit(inputs.voxels(spark, sf_dir), ["case_id", "z"]).groupBy("case_id", "z").agg(F.sum("byte").alias("total"))


@query(f"WITH {VOXELS}, {_STATS} SELECT case_id, label, {r6('avg(mean)', 'mean_mean')}, {r6('stddev_pop(mean)', 'mean_sd')} FROM st GROUP BY ALL")
def i12_over_slices(spark, sf_dir) -> DataFrame:
    return voxels.over_slices(voxels.roi_statistics(inputs.voxels(spark, sf_dir), [7, 20]), ["case_id", "label"], ["mean"])


@query(f"""WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS h, 20 + l_linenumber AS u, 22.0 + l_linenumber AS w, 30.0 AS s, 40.0 AS b, l_quantity * 35 AS a, l_linenumber % 3 = 0 AS last FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r6('CASE WHEN last THEN h / u ELSE 2 * h / (u + w) END', 'dhi')}, {r6('h / ((u + w) / 2 + 1e-6) * (s / (b + 1e-6))', 'msi')}, {r6('abs(u - w) / ((u + w) / 2 + 1e-6)', 'hai')}, {r6('a / (b * (u + w) / 2 + 1e-6)', 'dfi')}, {r6('h / b', 'dwr')}, {r6('greatest(0, least(100, (1 - h / 30.0) * 100))', 'dscr')}, {r6('(30.0 - h) / (30.0 + 1e-6)', 'smi')} FROM d""")
def i13_height_indices(spark, sf_dir) -> DataFrame:
    li = inputs.table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    rows = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("disc_height"), (20.0 + n).alias("upper_height"), (22.0 + n).alias("lower_height"), F.lit(30.0).alias("small_width"), F.lit(40.0).alias("big_width"), (F.col("l_quantity") * 35).alias("area"), (n % 3 == 0).alias("last"))
    dscr, smi = voxels.canal_indices(F.col("disc_height"), F.lit(30.0))
    return voxels.height_indices(rows).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "dhi", "msi", "hai", "dfi", "dwr", dscr.alias("dscr"), smi.alias("smi"))


@query(f"WITH {VOXELS}, s AS (SELECT case_id, z, y, max(x) - min(x) AS d FROM vox WHERE label = 7 AND intensity > 100 GROUP BY ALL), m AS (SELECT case_id, z, (min(y) + max(y)) // 2 AS y FROM vox WHERE label = 20 GROUP BY ALL) SELECT m.case_id, m.z, coalesce(d, 0) AS diameter FROM m LEFT JOIN s USING (case_id, z, y)")
def i13_sac_diameter(spark, sf_dir) -> DataFrame:
    vox = inputs.voxels(spark, sf_dir)
    return voxels.sac_diameter(vox.where("label = 20 OR intensity > 100"), 20, 7)


@query()
def i13_composite_indices(spark, sf_dir) -> DataFrame:
    """Indices of bright spots and texture over measured columns."""
    vox = inputs.voxels(spark, sf_dir)
    spots = voxels.bright_spots(vox, [7], factor=1.05)
    stats = voxels.roi_statistics(vox, [7]).select(*voxels.REGION, "sd", F.col("skew"), F.col("kurtosis"))
    texture = voxels.direction_statistics(voxels.gradients(vox), [7]).select(*voxels.REGION, "entropy", "resultant", F.col("mean").alias("magnitude"))
    one = lambda v: F.lit(float(v))
    rows = spots.join(stats, voxels.REGION).join(texture, voxels.REGION)
    rows = voxels.spot_indices(rows.withColumns({"posterior_distance": one(5), "circularity": one(0.8), "center_distance": one(3), "disc_radius": one(4), "ratio": one(1.2), "elongation": one(1.5)}))
    rows = voxels.texture_indices(rows.withColumns({"dist_mean": one(2), "dist_std": one(0.5), "dist_max": one(4), "lbp_entropy": one(3), "lbp_energy": one(0.2), "branches": one(4), "ends": one(2)}))
    return rows.select(*voxels.REGION, "risk", "tear", "degeneration", "integrity", "load")


@query(f"WITH {VOXELS} SELECT case_id, z, CAST(y + 1 AS INTEGER) AS y, CAST(x + 2 AS INTEGER) AS x, label, {r6('intensity', 'intensity')} FROM vox WHERE y + 1 <= 7 AND x + 2 <= 7")
def i15_translate(spark, sf_dir) -> DataFrame:
    return voxels.translate(inputs.voxels(spark, sf_dir), 1, 2, 8, 8)


_NEAR = "(SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)"


@query(f"WITH {VOXELS}, k AS (SELECT case_id, z, y, x, label, label = 7 AND intensity > 100 AS m FROM vox), g AS (SELECT DISTINCT case_id, z, y + dy AS y, x + dx AS x FROM k, {_NEAR} WHERE m) SELECT k.case_id, k.z, count(*) FILTER (g.y IS NOT NULL) AS n FROM k LEFT JOIN g USING (case_id, z, y, x) GROUP BY ALL")
def i15_dilate(spark, sf_dir) -> DataFrame:
    vox = inputs.voxels(spark, sf_dir)
    vox = vox.withColumn("label", F.when((F.col("label") == 7) & (F.col("intensity") > 100), 7).otherwise(0))
    return voxels.dilate(vox, [7]).groupBy("case_id", "z").agg(F.count_if(F.col("label") == 7).alias("n"))


@query(f"WITH {VOXELS} SELECT case_id, z, count(*) FILTER (label = 7 AND y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) AS n, count(*) FILTER (label = 20) AS sac FROM vox GROUP BY ALL")
def i15_erode(spark, sf_dir) -> DataFrame:
    return voxels.erode(inputs.voxels(spark, sf_dir), [7]).groupBy("case_id", "z").agg(F.count_if(F.col("label") == 7).alias("n"), F.count_if(F.col("label") == 20).alias("sac"))


@query(f"WITH {VOXELS} SELECT case_id, z, 8 - (x - 4) - 4 AS y, CAST(y AS INTEGER) AS x, label, {r6('intensity', 'intensity')} FROM vox WHERE 4 - (x - 4) BETWEEN 0 AND 7")
def i15_rotate(spark, sf_dir) -> DataFrame:
    """A quarter turn, which SQL has too: places keep whole coordinates."""
    return voxels.rotate(inputs.voxels(spark, sf_dir), 90.0, 8, 8).where("label IS NOT NULL")


@query()
def i15_all_conditions(spark, sf_dir) -> DataFrame:
    vox = inputs.voxels(spark, sf_dir)
    out = None
    for c in ("dilation", "erosion", "translation", "rotation", "gaussian_noise", "translation_rotation", "dilation_trans_rot", "erosion_trans_rot"):
        part = voxels.perturbed(vox, c, [7], 8, 8).select("condition", "label", "intensity")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("condition", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("mean"))


_G = "nb AS (SELECT a.case_id, a.z, a.y, a.x, a.label, b.y - a.y AS dy, b.x - a.x AS dx, b.intensity AS v FROM vox a JOIN vox b ON a.case_id = b.case_id AND a.z = b.z AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.label = 7), gr AS (SELECT case_id, z, y, x, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy FROM nb GROUP BY ALL)"


@query(f"WITH {VOXELS}, {_G} SELECT case_id, z, {r6('avg(sqrt(gx * gx + gy * gy))', 'mean')}, {r6('sqrt(power(avg(cos(atan2(gy, gx))), 2) + power(avg(sin(atan2(gy, gx))), 2))', 'resultant')} FROM gr GROUP BY ALL")
def i17_gradients(spark, sf_dir) -> DataFrame:
    return voxels.direction_statistics(voxels.gradients(inputs.voxels(spark, sf_dir)), [7]).select("case_id", "z", "mean", "resultant")


_DIRECTION = f"{_G}, gd AS (SELECT case_id, z, sqrt(gx * gx + gy * gy) AS m, atan2(gy, gx) AS d FROM gr), gm AS (SELECT case_id, z, avg(m) AS mean, stddev_pop(m) AS sd, max(m) AS high, sqrt(power(avg(cos(d)), 2) + power(avg(sin(d)), 2)) AS resultant FROM gd GROUP BY ALL), gc AS (SELECT case_id, z, avg(power(m - mean, 3)) / power(any_value(sd), 3) AS skew, avg(power(m - mean, 4)) / power(any_value(sd), 4) - 3 AS kurtosis FROM gd JOIN gm USING (case_id, z) GROUP BY ALL), gb AS (SELECT case_id, z, least(35, floor((d + pi()) / (2 * pi()) * 36)) AS b, count(*) AS n FROM gd GROUP BY ALL), ge AS (SELECT case_id, z, -sum(p * log2(p)) AS entropy FROM (SELECT case_id, z, n / sum(n) OVER (PARTITION BY case_id, z) AS p FROM gb) GROUP BY ALL)"


@query(f"WITH {VOXELS}, {_DIRECTION} SELECT case_id, z, 7 AS label, {', '.join(r6(c, c) for c in ('entropy', 'resultant', 'mean', 'sd', 'high', 'skew', 'kurtosis'))} FROM gm JOIN gc USING (case_id, z) JOIN ge USING (case_id, z)")
def i17_direction_entropy(spark, sf_dir) -> DataFrame:
    return voxels.direction_statistics(voxels.gradients(inputs.voxels(spark, sf_dir)), [7])


@query(f"""WITH {VOXELS}, {_SI.split(', p AS ')[0]}, {_DIRECTION}, sm AS (SELECT case_id, z, CASE WHEN m2 < 1e-8 THEN 0 ELSE m3 / power(m2 + 1e-8, 1.5) END AS skew, CASE WHEN m2 < 1e-8 THEN 0 ELSE m4 / power(m2 + 1e-8, 2) - 3 END AS kurtosis FROM st JOIN mo USING (case_id, z, label) WHERE label = 7),
t AS (SELECT case_id, z, sm.skew AS s, sm.kurtosis AS k, entropy, resultant, gm.mean AS g FROM sm JOIN gm USING (case_id, z) JOIN ge USING (case_id, z))
SELECT case_id, z, {r6('0.3 * 0.75 + 0.3 * 0.2 + 0.2 * least(entropy / 5.5, 1) + 0.2 * (0.5 / (2 + 1e-8))', 'degeneration')}, {r6('0.4 / 3.0 + 0.4 * resultant + 0.2 * exp(-0.5)', 'integrity')},
  {r6('0.4 * 0.8 + 0.3 * greatest(0, least(1, (1 / (1 + exp(-s)) - 0.5) * 2)) + 0.3 * (1 - least(abs(k), 1))', 'inflammatory')}, {r6('0.4 * (1 - 0.5 / (2 + 1e-8)) + 0.3 * tanh(g / 50) + 0.3 * 0.8', 'load')} FROM t""")
def i13_texture_indices(spark, sf_dir) -> DataFrame:
    """Texture indices of measured columns, and given ones where a measure has no SQL."""
    vox = inputs.voxels(spark, sf_dir)
    stats = voxels.roi_statistics(vox, [7]).select(*voxels.REGION, "skew", "kurtosis")
    texture = voxels.direction_statistics(voxels.gradients(vox), [7]).select(*voxels.REGION, "entropy", "resultant", F.col("mean").alias("magnitude"))
    one = lambda v: F.lit(float(v))
    rows = stats.join(texture, voxels.REGION).withColumns({"dist_mean": one(2), "dist_std": one(0.5), "dist_max": one(4), "lbp_entropy": one(3), "lbp_energy": one(0.2), "branches": one(4), "ends": one(2)})
    return voxels.texture_indices(rows).select("case_id", "z", "degeneration", "integrity", "inflammatory", "load")


@query(f"WITH {VOXELS} SELECT case_id, x, count(*) AS n FROM vox WHERE x IN (3, 4) GROUP BY ALL")
def i01_middle_slices_by_spacing(spark, sf_dir) -> DataFrame:
    """Slices lie along the axis of the largest spacing, here x."""
    return voxels.middle_slices(inputs.voxels(spark, sf_dir), 2, (0.7, 0.7, 4.0)).groupBy("case_id", "x").agg(F.count(F.lit(1)).alias("n"))


_ABOUT = "3.5::DOUBLE AS cy, (36 * 3.5 + 8 * 7) / 44::DOUBLE AS cx"


@query(f"""WITH {VOXELS}, s AS (SELECT case_id, z, y, x, cy + (x - cx) AS sy, cx - (y - cy) AS sx FROM vox, (SELECT {_ABOUT})),
o AS (SELECT *, floor(round(sy, 9)) AS y0, floor(round(sx, 9)) AS x0 FROM s), w AS (SELECT *, greatest(0, sy - y0) AS fy, greatest(0, sx - x0) AS fx FROM o)
SELECT w.case_id, w.z, CAST(w.y AS INTEGER) AS y, CAST(w.x AS INTEGER) AS x,
  {r6('coalesce(a.intensity, 0) * (1 - fy) * (1 - fx) + coalesce(b.intensity, 0) * (1 - fy) * fx + coalesce(c.intensity, 0) * fy * (1 - fx) + coalesce(d.intensity, 0) * fy * fx', 'intensity')}, coalesce(l.label, 0) AS label
FROM w LEFT JOIN vox a ON a.case_id = w.case_id AND a.z = w.z AND a.y = y0 AND a.x = x0 LEFT JOIN vox b ON b.case_id = w.case_id AND b.z = w.z AND b.y = y0 AND b.x = x0 + 1
LEFT JOIN vox c ON c.case_id = w.case_id AND c.z = w.z AND c.y = y0 + 1 AND c.x = x0 LEFT JOIN vox d ON d.case_id = w.case_id AND d.z = w.z AND d.y = y0 + 1 AND d.x = x0 + 1
LEFT JOIN vox l ON l.case_id = w.case_id AND l.z = w.z AND l.y = floor(round(sy, 9) + 0.5) AND l.x = floor(round(sx, 9) + 0.5)""")
def i15_rotate_about_mask(spark, sf_dir) -> DataFrame:
    """A quarter turn about the mask's centroid, between pixels."""
    return voxels.rotate_about_mask(inputs.voxels(spark, sf_dir), 90.0, 8, 8)


# the same jobs on one slice per row


def _slices(spark, sf_dir) -> DataFrame:
    return slices.to_slices(inputs.voxels(spark, sf_dir), 8, 8)


@query(ORACLES["i07_box_counts"])
def i07_box_counts_by_slice(spark, sf_dir) -> DataFrame:
    return slices.box_counts(_slices(spark, sf_dir), 110)


@query(ORACLES["i15_translate"])
def i15_translate_by_slice(spark, sf_dir) -> DataFrame:
    return slices.to_voxels(slices.translate(_slices(spark, sf_dir), 1, 2))


@query(ORACLES["i15_dilate"])
def i15_dilate_by_slice(spark, sf_dir) -> DataFrame:
    vox = inputs.voxels(spark, sf_dir)
    vox = vox.withColumn("label", F.when((F.col("label") == 7) & (F.col("intensity") > 100), 7).otherwise(0))
    grown = slices.dilate(slices.to_slices(vox, 8, 8), [7])
    return grown.select("case_id", "z", F.size(F.filter("labels", lambda v: v == 7)).cast("long").alias("n"))


@query(ORACLES["i15_erode"])
def i15_erode_by_slice(spark, sf_dir) -> DataFrame:
    count = lambda k: F.size(F.filter("labels", lambda v: v == k)).cast("long")
    return slices.erode(_slices(spark, sf_dir), [7]).select("case_id", "z", count(7).alias("n"), count(20).alias("sac"))


@query(ORACLES["i17_gradients"])
def i17_gradients_by_slice(spark, sf_dir) -> DataFrame:
    grad = slices.to_voxels(slices.gradients(_slices(spark, sf_dir)), "magnitude", "direction")
    return voxels.direction_statistics(grad, [7]).select("case_id", "z", "mean", "resultant")
