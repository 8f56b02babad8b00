"""Statistics and transforms of voxel tables (case_id, z, y, x, intensity, label)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import gaussian_pairs
from . import runs

#: Labels of discs and of the sac.
DISC_LABELS = {"L1-L2": 3, "L2-L3": 5, "L3-L4": 7, "L4-L5": 9, "L5-S1": 11}
SAC_LABEL = 20
SLICE = ["case_id", "z"]
REGION = ["case_id", "z", "label"]


def slice_axis(spacing: tuple[float, float, float]) -> str:
    """The axis along which slices lie: that of the largest spacing (z, y, x), the first of equals."""
    return "zyx"[int(np.argmax(spacing))]


def middle_slices(vox: DataFrame, n: int, spacing: tuple[float, float, float] | None = None) -> DataFrame:
    """Voxels of the n slices around size // 2 (clipped to the volume), along z or the axis of largest spacing."""
    axis = slice_axis(spacing) if spacing else "z"
    sizes = vox.groupBy("case_id").agg((F.max(axis) + 1).alias("__size"))
    rows = vox.join(sizes, "case_id").withColumn("__s", F.greatest(F.lit(0), F.floor(F.col("__size") / 2) - n // 2))
    return rows.where((F.col(axis) >= F.col("__s")) & (F.col(axis) < F.col("__s") + n)).select(*vox.columns)


def extents(vox: DataFrame, spacing: tuple[float, float, float], labels: list[int]) -> DataFrame:
    """(case_id, label, dz, dy, dx): size of each disc in millimetres."""
    size = lambda c, s: ((F.max(c) - F.min(c) + 1) * float(s)).alias(f"d{c}")
    return vox.where(F.col("label").isin(labels)).groupBy("case_id", "label").agg(*[size(c, s) for c, s in zip("zyx", spacing, strict=True)])


def roi_size(table: DataFrame, spacing: tuple[float, float, float], margin: float = 3.0, share: float = 0.98, multiple: int = 8) -> DataFrame:
    """(nz, ny, nx): ceil((p98 + 2 margin) / spacing), rounded up to a multiple of 8."""
    up = lambda c, s: (F.ceil(F.ceil((F.percentile(f"d{c}", F.lit(share)) + 2 * margin) / s) / multiple) * multiple).cast("int").alias(f"n{c}")
    return table.agg(*[up(c, s) for c, s in zip("zyx", spacing, strict=True)])


def roi_statistics(vox: DataFrame, labels: list[int], eps: float = 1e-8) -> DataFrame:
    """Per (case, slice, label): n, mean, sd, cv, min, max, median, skew and excess kurtosis from central moments (0 for a flat region)."""
    rows = vox.where(F.col("label").isin(labels))
    basic = rows.groupBy(*REGION).agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("mean"), F.stddev_pop("intensity").alias("sd"), F.min("intensity").alias("low"), F.max("intensity").alias("high"), F.median("intensity").alias("median"))
    d = F.col("intensity") - F.col("mean")
    moments = rows.join(basic.select(*REGION, "mean"), REGION).groupBy(*REGION).agg(F.avg(d * d).alias("m2"), F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"))
    flat = F.col("m2") < eps
    out = basic.join(moments, REGION)
    return out.select(
        *REGION,
        "n",
        "mean",
        "sd",
        F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0).alias("cv"),
        "low",
        "high",
        "median",
        F.when(flat, 0.0).otherwise(F.col("m3") / F.pow(F.col("m2") + eps, 1.5)).alias("skew"),
        F.when(flat, 0.0).otherwise(F.col("m4") / F.pow(F.col("m2") + eps, 2) - 3).alias("kurtosis"),
    )


def signal_indices(stats: DataFrame, ratio: str = "si_ratio", eps: float = 1e-8) -> DataFrame:
    """Hydration, heterogeneity, nucleus activity and degeneration indices from region statistics and the signal ratio."""
    r, shr = F.col(ratio), F.col("sd") / (F.col("mean") + eps)
    rapid = 0.5 * (1 - F.least(r, F.lit(1.0))) + 0.3 * F.greatest(F.col("skew"), F.lit(0.0)) + 0.2 * (1 - F.least(F.abs("kurtosis"), F.lit(1.0)))
    few = F.col("n") < 3
    zero = lambda c: F.when(few, 0.0).otherwise(c)
    return stats.withColumns({"hydration": zero(r), "heterogeneity": zero(shr), "nucleus_activity": zero(0.6 * r + 0.4 / (shr + eps)), "rapid_degeneration": zero(rapid)})


def pure_mean(rows: DataFrame, keys: list[str], value: str = "intensity") -> DataFrame:
    """(keys, signal): mean of the pixels over their 25th percentile where there are more than 20 pixels and more than 10 such, else of all."""
    q = rows.groupBy(*keys).agg(F.percentile(value, F.lit(0.25)).alias("__q"), F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__m"))
    over = F.col(value) > F.col("__q")
    t = rows.join(q, keys).groupBy(*keys).agg(F.first("__n").alias("n"), F.first("__m").alias("m"), F.count_if(over).alias("k"), F.avg(F.when(over, F.col(value))).alias("p"))
    return t.select(*keys, F.when((F.col("n") > 20) & (F.col("k") > 10), F.col("p")).otherwise(F.col("m")).alias("signal"))


def signal_ratio(vox: DataFrame, labels: list[int], reference: int = SAC_LABEL) -> DataFrame:
    """Per (case, slice, label): signal, reference signal and their ratio. Without reference pixels in a slice the 95th percentile of the slice stands in."""
    roi = pure_mean(vox.where(F.col("label").isin(labels)), REGION)
    csf = pure_mean(vox.where(F.col("label") == reference), SLICE).withColumnRenamed("signal", "csf")
    other = vox.groupBy(*SLICE).agg(F.percentile("intensity", F.lit(0.95)).alias("p95"))
    ref = F.coalesce("csf", "p95")
    return roi.join(other, SLICE).join(csf, SLICE, "left").select(*REGION, "signal", ref.alias("reference"), F.when(ref > 0, F.col("signal") / ref).otherwise(0.0).alias("si_ratio"))


#: Bins of a region's intensities, between its extremes.
BINS = 16_384


def mixture_peaks(vox: DataFrame, labels: list[int]) -> DataFrame:
    """(case_id, z, label, low, high, difference, index): peaks of two Gaussians in a region's intensities; null intensities are left out.

    The fit works on BINS counts, means and spreads of narrow bins, which are added up across partitions, so that no task gathers a
    region's pixels, and regions are fitted many at once. A bin's pixels share their chances at its mean, which moves the peaks by about the square of its width.
    """

    def fit(frames):
        for frame in runs.whole(frames, REGION):
            at, n = runs.starts(frame, REGION), frame["n"].to_numpy(float)
            x = frame["s"].to_numpy() / n
            mean, sd, _ = gaussian_pairs(at, x + frame["low"].to_numpy(), n, np.maximum(frame["ss"].to_numpy() / n - x * x, 0))
            gap = mean[1] - mean[0]
            yield frame[REGION].iloc[at].assign(low=mean[0], high=mean[1], difference=gap, index=gap / (sd.sum(axis=0) + 1e-8))

    rows = vox.where(F.col("label").isin(labels) & F.col("intensity").isNotNull()).select(*REGION, F.col("intensity").cast("double").alias("v"))
    ends = rows.groupBy(*REGION).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    off = F.col("v") - F.col("low")  # sums from the least value on keep their digits
    place = F.coalesce(F.floor(F.try_divide(off * BINS, F.col("high") - F.col("low"))), F.lit(0)).alias("bin")
    cells = rows.join(ends, REGION).groupBy(*REGION, place).agg(F.count(F.lit(1)).alias("n"), F.sum(off).alias("s"), F.sum(off * off).alias("ss"), F.first("low").alias("low"))
    return runs.gathered(cells, REGION, "bin").mapInPandas(fit, "case_id long, z int, label int, low double, high double, difference double, index double")


def box_counts(edges: DataFrame, keys: list[str], height: int, width: int, least: int = 1, most: int | None = None) -> DataFrame:
    """(keys, box, n): boxes of side 1, 2, 4, … up to min(max(h, w) // 4, 128) that hold an edge pixel (y, x)."""
    top = most or min(max(height, width) // 4, 128)
    sizes = [least * 2**i for i in range(64) if least * 2**i <= top]
    each = edges.select(*keys, "y", "x", F.explode(F.lit(sizes)).alias("box"))
    return each.groupBy(*keys, "box").agg(F.count_distinct(F.floor(F.col("y") / F.col("box")), F.floor(F.col("x") / F.col("box"))).alias("n"))


def fractal_dimension(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fd, r_squared): minus the slope of log n on log box."""
    lx, ly = F.log("box"), F.log("n")
    t = counts.groupBy(*keys).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_r2(ly, lx).alias("r_squared"))
    return t.select(*keys, (-F.col("slope")).alias("fd"), "r_squared")


def _cube(d: Column) -> Column:
    """d^3 rounded once, as C's pow has it (Java's is off by a last digit now and then): products with their errors, by halves of the digits."""
    s = d * d

    def halves(v):
        high = v * 134217729.0 - (v * 134217729.0 - v)
        return high, v - high

    (h, low), (sh, sl) = halves(d), halves(s)
    of_square = ((h * h - s) + 2.0 * h * low) + low * low
    of_cube = ((sh * h - s * d) + sh * low + sl * h) + sl * low
    return s * d + (of_cube + of_square * d)


def hu_moments(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area, hu1..hu7, log1..log7) of mask pixels (y, x); log is -sign(h) log10 |h|, 0 for 0 and what rounding leaves of it.

    Terms are added from the last pixel (y, x) to the first, the order in which the SQL adds them: of a symmetric mask hu5 and hu7 are but the
    rounding of these sums, which would otherwise follow the order in which rows arrive. A group's pixels are those of one mask.
    """
    power = lambda b, n: b * b if n == 2 else _cube(b) if n == 3 else b
    orders = [(p, q) for p in range(4) for q in range(4) if 2 <= p + q <= 3]
    c = mask.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.sort_array(F.collect_list(F.struct("y", "x")), asc=False).alias("pixels"))

    def term(pixel: Column, p: int, q: int) -> Column:
        dx, dy = pixel["x"] - F.col("cx"), pixel["y"] - F.col("cy")
        return power(dx, p) if q == 0 else power(dy, q) if p == 0 else dx * dx * dy if p == 2 else dx * dy * dy if q == 2 else dx * dy

    sums = F.aggregate("pixels", F.struct(*[F.lit(0.0).alias(f"m{p}{q}") for p, q in orders]), lambda s, v: F.struct(*[(s[f"m{p}{q}"] + term(v, p, q)).alias(f"m{p}{q}") for p, q in orders]))
    area = F.col("area")
    scale = {2: area * area, 3: F.sqrt(area * area * area * area * area)}  # area^(1 + order / 2), rounded once
    m = c.select(*keys, "area", sums.alias("m")).select(*keys, "area", *[(F.col(f"m.m{p}{q}") / scale[p + q]).alias(f"n{p}{q}") for p, q in orders])
    n = {pq: F.col(f"n{pq[0]}{pq[1]}") for pq in orders}
    a, b = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3]
    c3, d3 = n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    hu = [
        n[2, 0] + n[0, 2],
        power(n[2, 0] - n[0, 2], 2) + 4 * power(n[1, 1], 2),
        power(c3, 2) + power(d3, 2),
        power(a, 2) + power(b, 2),
        c3 * a * (power(a, 2) - 3 * power(b, 2)) + d3 * b * (3 * power(a, 2) - power(b, 2)),
        (n[2, 0] - n[0, 2]) * (power(a, 2) - power(b, 2)) + 4 * n[1, 1] * a * b,
        d3 * a * (power(a, 2) - 3 * power(b, 2)) - c3 * b * (3 * power(a, 2) - power(b, 2)),
    ]
    out = m.select(*keys, "area", *[h.alias(f"hu{i}") for i, h in enumerate(hu, 1)])
    log = lambda h: F.when(F.abs(h) < 1e-30, 0.0).otherwise(-F.signum(h) * F.log10(F.abs(h)))
    return out.select("*", *[log(F.col(f"hu{i}")).alias(f"log{i}") for i in range(1, 8)])


def components8(mask: np.ndarray) -> np.ndarray:
    """Labels of the 8-connected components of a boolean image, from 1 in reading order.

    Runs of pixels in a row are the nodes; a run touches those of the row before that begin no later than one place behind it and end no
    earlier than one before it. Of linked runs the least takes all over, until no link joins two.
    """
    height, width = mask.shape
    edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    stride = width + 2
    low = np.searchsorted(row * stride + stop, (row - 1) * stride + start, side="left")
    high = np.searchsorted(row * stride + start, (row - 1) * stride + stop, side="right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(row))
    while True:
        least = np.minimum(root[a], root[b])
        apart = root[a] != root[b]
        if not apart.any():
            break
        for end in (a, b):
            np.minimum.at(root, root[end[apart]], least[apart])
        while (root[root] != root).any():
            root = root[root]
    out = np.zeros(mask.shape, np.int64)
    out[mask] = np.repeat(np.unique(root, return_inverse=True)[1] + 1, stop - start)
    return out


def bright_spots(vox: DataFrame, labels: list[int], factor: float = 0.15, least: int = 3, most: int = 2000, reference: int = SAC_LABEL) -> DataFrame:
    """(case_id, z, label, size, mean, score, candidates): the best bright component of each disc.

    Disc pixels over factor times the 75th percentile of the reference (half the slice's maximum without one) are joined to 8-connected
    components of least..most pixels; the score is 0.6 mean/255 + 0.4 min(size/100, 1), and of equal scores the first in reading order is taken.
    """
    csf = vox.where(F.col("label") == reference).groupBy(*SLICE).agg(F.percentile("intensity", F.lit(0.75)).alias("csf"))
    top = vox.groupBy(*SLICE).agg((0.5 * F.max("intensity")).alias("half"))
    level = top.join(csf, SLICE, "left").select(*SLICE, (F.lit(factor) * F.coalesce("csf", "half")).alias("level"))
    bright = vox.where(F.col("label").isin(labels)).join(level, SLICE).where(F.col("intensity") > F.col("level"))

    def label(key, frame: pd.DataFrame) -> pd.DataFrame:
        y, x = frame["y"].to_numpy() - frame["y"].min(), frame["x"].to_numpy() - frame["x"].min()
        image = np.zeros((y.max() + 1, x.max() + 1), bool)
        image[y, x] = True
        part = components8(image)[y, x]
        t = pd.DataFrame({"part": part, "v": frame["intensity"]}).groupby("part")["v"].agg(["size", "mean"]).reset_index()
        t = t[(t["size"] >= least) & (t["size"] <= most)]
        if not len(t):
            return pd.DataFrame([], columns=[*REGION, "size", "mean", "score", "candidates"])
        score = 0.6 * t["mean"] / 255 + 0.4 * np.minimum(t["size"] / 100, 1)
        i = int(score.to_numpy().argmax())
        return pd.DataFrame([(*key, int(t["size"].iloc[i]), float(t["mean"].iloc[i]), float(score.iloc[i]), len(t))], columns=[*REGION, "size", "mean", "score", "candidates"])

    return bright.select(*REGION, "y", "x", "intensity").groupBy(*REGION).applyInPandas(label, "case_id long, z int, label int, size long, mean double, score double, candidates long")


def endplate_changes(vox: DataFrame, vertebra: int, ratio: float = 0.2) -> DataFrame:
    """(case_id, z, plate, n, mean, sd, type, severity): abnormal pixels of a vertebra's upper and lower strips.

    Abnormal is outside 15 % of the vertebra's mean. Bright and heterogeneous (sd/mean over 0.25) is type 1, bright type 2, dark type 3, else 0.
    """
    v = vox.where(F.col("label") == vertebra)
    box = v.groupBy(*SLICE).agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.avg("intensity").alias("ref"))
    h = F.greatest(F.lit(1), F.bround((F.col("bottom") - F.col("top")) * ratio).cast("int"))
    rows = v.join(box, SLICE).withColumn("h", h)
    upper, lower = F.col("y") < F.col("top") + F.col("h"), F.col("y") >= F.col("bottom") - F.col("h")
    plates = F.explode(F.array_compact(F.array(F.when(upper, F.lit("upper")), F.when(lower, F.lit("lower")))))
    odd = (F.col("intensity") > F.col("ref") * 1.15) | (F.col("intensity") < F.col("ref") * 0.85)
    t = rows.where(odd).select(*SLICE, "ref", "intensity", plates.alias("plate")).groupBy(*SLICE, "plate").agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("mean"), F.stddev_pop("intensity").alias("sd"), F.first("ref").alias("ref"))
    bright, dark = F.col("mean") > F.col("ref") * 1.15, F.col("mean") < F.col("ref") * 0.85
    mixed = F.col("sd") / F.col("mean") > 0.25
    kind = F.when(bright & mixed, 1).when(bright, 2).when(dark, 3).otherwise(0)
    severity = F.when(bright & mixed, 0.9).when(bright, 0.5).when(dark, 0.6).otherwise(0.0)
    return t.select(*SLICE, "plate", "n", "mean", "sd", kind.alias("type"), severity.alias("severity"))


def endplate_summary(regions: DataFrame, keys: list[str]) -> DataFrame:
    """Risk, inflammatory activity and structural stability of a case's regions."""
    t = regions.groupBy(*keys).agg(F.count(F.lit(1)).alias("regions"), F.avg((F.col("type") == 1).cast("double")).alias("share1"), F.avg((F.col("type") == 3).cast("double")).alias("share3"), F.avg("severity").alias("m"), F.stddev_pop("severity").alias("s"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return t.select(
        *keys,
        "regions",
        "share1",
        (0.3 * F.least(F.col("regions") / 10.0, F.lit(1.0)) + 0.4 * F.col("share1") + 0.3 * F.col("m")).alias("risk"),
        (F.col("share1") * F.col("m")).alias("activity"),
        (0.4 * F.col("share3") + 0.3 * clip(1 - F.col("s")) + 0.3 * clip(1 - F.col("m"))).alias("stability"),
    )


def normalize(vox: DataFrame, keys: list[str], robust: bool = False) -> DataFrame:
    """Rows with `z_score` within the keys: by mean and deviation, or by median and IQR/1.349; fewer than two pixels: 0."""
    if robust:
        t = vox.groupBy(*keys).agg(F.median("intensity").alias("__c"), (F.percentile("intensity", F.lit(0.75)) - F.percentile("intensity", F.lit(0.25))).alias("__i"), F.count(F.lit(1)).alias("__n"))
        t = t.withColumn("__s", F.when(F.col("__i") > 1e-6, F.col("__i") / 1.349).otherwise(1e-6)).drop("__i")
    else:
        t = vox.groupBy(*keys).agg(F.avg("intensity").alias("__c"), F.stddev_pop("intensity").alias("__s"), F.count(F.lit(1)).alias("__n"))
    z = F.when(F.col("__n") < 2, 0.0).otherwise(F.coalesce(F.try_divide(F.col("intensity") - F.col("__c"), F.col("__s")), F.lit(0.0)))
    return vox.join(t, keys).withColumn("z_score", z).drop("__c", "__s", "__n")


def to_8bit(vox: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows with `byte`: clipped at two percentiles of the keys' pixels and stretched to 0..255, cut down to whole numbers."""
    t = vox.groupBy(*keys).agg(F.percentile("intensity", F.lit(low)).alias("__l"), F.percentile("intensity", F.lit(high)).alias("__h"))
    x = F.greatest(F.col("__l"), F.least(F.col("__h"), F.col("intensity")))
    byte = F.when(F.col("__h") > F.col("__l"), F.floor((x - F.col("__l")) / (F.col("__h") - F.col("__l")) * 255)).otherwise(0)
    return vox.join(t, keys).withColumn("byte", byte.cast("int")).drop("__l", "__h")


def window_level(c: Column, center: float = 128, width: float = 255) -> Column:
    low, high = center - width / 2, center + width / 2
    return (F.greatest(F.lit(low), F.least(F.lit(high), c)) - low) / (high - low) * 255 if high > low else F.lit(0.0)


def discretize(vox: DataFrame, keys: list[str], width: float = 16) -> DataFrame:
    """Rows with `level`: bins of `width` from the keys' minimum."""
    t = vox.groupBy(*keys).agg(F.min("intensity").alias("__l"), F.max("intensity").alias("__h"))
    bins = F.greatest(F.lit(1), F.ceil((F.col("__h") - F.col("__l")) / width))
    return vox.join(t, keys).withColumn("level", F.least(bins - 1, F.floor((F.col("intensity") - F.col("__l")) / width)).cast("int")).drop("__l", "__h")


def binarize(vox: DataFrame, keys: list[str], share: float | None = None) -> DataFrame:
    """Rows with `bit`: over the keys' percentile, or over their mean."""
    t = vox.groupBy(*keys).agg((F.percentile("intensity", F.lit(share)) if share is not None else F.avg("intensity")).alias("__t"))
    return vox.join(t, keys).withColumn("bit", (F.col("intensity") > F.col("__t")).cast("int")).drop("__t")


def over_slices(stats: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Mean and population deviation over a region's slices; a slice whose value is null counts in neither."""
    return stats.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))])


def height_indices(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """DHI, MSI, HAI, DFI and DWR from heights, widths and the disc's area; with no lower vertebra counted (`last`), height over the upper one."""
    h, up, low, small, big = (F.col(c) for c in ("disc_height", "upper_height", "lower_height", "small_width", "big_width"))
    mean = (up + low) / 2
    dhi = F.when(F.col("last"), F.when(up > 0, h / up).otherwise(0.0)).otherwise(F.when(up + low < 1e-6, 0.0).otherwise(2 * h / (up + low)))
    return rows.withColumns(
        {
            "dhi": dhi,
            "msi": h / (mean + eps) * (small / (big + eps)),
            "hai": F.abs(up - low) / (mean + eps),
            "dfi": F.col("area") / (big * mean + eps),
            "dwr": F.when(big > 0, h / big).otherwise(0.0),
        }
    )


def canal_indices(actual: Column, ideal: Column, eps: float = 1e-6) -> tuple[Column, Column]:
    """Stenosis in percent of the ideal diameter, clipped to 0..100, and the narrowing index."""
    dscr = F.when(ideal > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - actual / ideal) * 100))).otherwise(0.0)
    return dscr, F.when(ideal > 0, (ideal - actual) / (ideal + eps)).otherwise(0.0)


def sac_diameter(vox: DataFrame, disc: int, sac: int = SAC_LABEL) -> DataFrame:
    """(case_id, z, diameter): extent in x of the sac on the disc's middle row; 0 where the sac is not on it."""
    mid = vox.where(F.col("label") == disc).groupBy(*SLICE).agg(F.floor((F.min("y") + F.max("y")) / 2).alias("__y"))
    rows = vox.where(F.col("label") == sac).groupBy(*SLICE, "y").agg((F.max("x") - F.min("x")).alias("d"))
    return mid.join(rows, (mid["case_id"] == rows["case_id"]) & (mid["z"] == rows["z"]) & (mid["__y"] == rows["y"]), "left").select(mid["case_id"], mid["z"], F.coalesce("d", F.lit(0)).alias("diameter"))


def spot_indices(rows: DataFrame, largest: float = 2000.0, eps: float = 1e-8) -> DataFrame:
    """Prognostic risk, instability, inflammatory activity and tear severity from measured columns of a bright spot."""
    c, one = F.col, F.lit(1.0)
    risk = 0.3 * F.least(c("mean") / 255, one) + 0.3 * F.least(c("size") / largest, one) + 0.2 * (1 - F.least(c("posterior_distance") / 50, one)) + 0.2 * F.greatest(F.lit(0.0), 1 - c("circularity"))
    spread = c("sd") / (c("mean") + eps)
    return rows.withColumns(
        {
            "risk": risk,
            "instability": c("center_distance") / (c("disc_radius") + eps),
            "activity": 0.6 * F.least(c("ratio") / 3, one) + 0.4 * F.least(2 * spread, one),
            "tear": 0.4 * F.least(c("size") / 100, one) + 0.3 * F.least(c("candidates") / 5, one) + 0.3 * F.least(c("elongation") / 3, one),
        }
    )


def texture_indices(rows: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Degeneration, integrity, inflammatory and load indices from measured texture columns."""
    c, one, zero = F.col, F.lit(1.0), F.lit(0.0)
    ratio = c("dist_std") / (c("dist_mean") + eps)
    skew = F.greatest(zero, F.least(one, (1 / (1 + F.exp(-c("skew"))) - 0.5) * 2))
    return rows.withColumns(
        {
            "degeneration": 0.3 * F.least(c("lbp_entropy") / 4, one) + 0.3 * F.least(c("branches") / 20, one) + 0.2 * F.least(c("entropy") / 5.5, one) + 0.2 * F.least(ratio, one),
            "integrity": 0.4 / (c("ends") + 1) + 0.4 * c("resultant") + 0.2 * F.exp(-0.5 * F.pow(c("dist_max") - 5, 2)),
            "inflammatory": 0.4 * (1 - c("lbp_energy")) + 0.3 * skew + 0.3 * (1 - F.least(F.abs("kurtosis"), one)),
            "load": 0.4 * F.greatest(zero, 1 - ratio) + 0.3 * F.tanh(c("magnitude") / 50) + 0.3 * F.greatest(zero, 1 - c("branches") / 20),
        }
    )


# perturbations: the label travels with its voxel, the intensity is read from where the voxel came from


def translate(vox: DataFrame, dy: int, dx: int, height: int, width: int) -> DataFrame:
    """Voxels moved by whole pixels; what leaves the image goes, and places without a voxel are absent (0)."""
    moved = vox.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
    return moved.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def rotate(vox: DataFrame, degrees: float, height: int, width: int) -> DataFrame:
    """Slices rotated about (h//2, w//2): labels from the nearest source pixel, intensities bilinear, outside 0.

    Each target place has four source cells with weights, so the work is one equi-join on whole coordinates.
    """
    cy, cx, a = height // 2, width // 2, math.radians(degrees)
    cos, sin = math.cos(a), math.sin(a)
    table = []
    for y in range(height):
        for x in range(width):
            sy, sx = cy + (y - cy) * cos + (x - cx) * sin, cx - (y - cy) * sin + (x - cx) * cos
            y0, x0 = math.floor(sy + 1e-9), math.floor(sx + 1e-9)
            fy, fx = max(sy - y0, 0.0), max(sx - x0, 0.0)
            near = (math.floor(sy + 0.5), math.floor(sx + 0.5))
            for ay, wy in ((y0, 1 - fy), (y0 + 1, fy)):
                for ax, wx in ((x0, 1 - fx), (x0 + 1, fx)):
                    if 0 <= ay < height and 0 <= ax < width and (wy * wx > 0 or (ay, ax) == near):
                        table.append((ay, ax, y, x, wy * wx, (ay, ax) == near))
    spark = vox.sparkSession
    t = spark.createDataFrame(table, "y int, x int, ty int, tx int, w double, near boolean")  # four rows per place of a slice
    joined = vox.join(F.broadcast(t), ["y", "x"])
    out = joined.groupBy(*SLICE, "ty", "tx").agg(F.sum(F.col("w") * F.col("intensity")).alias("intensity"), F.coalesce(F.max(F.when(F.col("near"), F.col("label"))), F.lit(0)).alias("label"))
    return out.withColumnsRenamed({"ty": "y", "tx": "x"})


def rotate_about_mask(vox: DataFrame, degrees: float, height: int, width: int) -> DataFrame:
    """Volumes rotated in their slices about the centroid of the whole volume's mask (labels over 0): labels from the nearest source
    pixel, intensities bilinear, outside 0. Volumes without a mask turn about their slices' middle.

    Every voxel's place is also a target place; a target's four sources, whose coordinates depend on the volume, meet their voxels in
    one equi-join.
    """
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    masked = F.col("label") > 0
    middle = vox.groupBy("case_id").agg(F.avg(F.when(masked, F.col("y"))).alias("cy"), F.avg(F.when(masked, F.col("x"))).alias("cx"))
    middle = middle.select("case_id", F.coalesce("cy", F.lit(float(height // 2))).alias("cy"), F.coalesce("cx", F.lit(float(width // 2))).alias("cx"))
    dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
    at = vox.select(*SLICE, "y", "x").join(middle, "case_id").select(*SLICE, "y", "x", (F.col("cy") + dy * cos + dx * sin).alias("sy"), (F.col("cx") - dy * sin + dx * cos).alias("sx"))
    low = lambda c: F.floor(F.round(F.col(c), 9))
    at = at.withColumns({"y0": low("sy"), "x0": low("sx"), "ny": F.floor(F.round(F.col("sy"), 9) + 0.5), "nx": F.floor(F.round(F.col("sx"), 9) + 0.5)})
    fy, fx = F.greatest(F.col("sy") - F.col("y0"), F.lit(0.0)), F.greatest(F.col("sx") - F.col("x0"), F.lit(0.0))
    corners = [F.struct((F.col("y0") + j).alias("y"), (F.col("x0") + i).alias("x"), ((fy if j else 1 - fy) * (fx if i else 1 - fx)).alias("w")) for j in (0, 1) for i in (0, 1)]
    near = F.struct(F.col("ny").alias("y"), F.col("nx").alias("x"), F.lit(None).cast("double").alias("w"))  # carries the label alone
    targets = at.select(*SLICE, F.col("y").alias("ty"), F.col("x").alias("tx"), F.explode(F.array(*corners, near)).alias("c")).select(*SLICE, "ty", "tx", "c.*")
    joined = targets.join(vox.select(*SLICE, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "intensity", "label"), [*SLICE, "y", "x"], "left")
    out = joined.groupBy(*SLICE, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(
        F.coalesce(F.sum(F.col("w") * F.col("intensity")), F.lit(0.0)).alias("intensity"), F.coalesce(F.max(F.when(F.col("w").isNull(), F.col("label"))), F.lit(0)).alias("label")
    )
    return out


def noise(vox: DataFrame, sd: float, seed: int = 0) -> DataFrame:
    """Gaussian noise that depends on the voxel's place and the seed alone: Box-Muller on two hashes."""
    place = [F.col("case_id"), F.col("z"), F.col("y"), F.col("x")]
    u = lambda k: (F.pmod(F.xxhash64(*place, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return vox.withColumn("intensity", F.col("intensity") + sd * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2)))


def _spread(mask: DataFrame, axis: str, radius: int) -> DataFrame:
    """Each row at all places up to `radius` along an axis: two passes along the axes make a square."""
    return mask.withColumn(axis, F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius)))


def dilate(vox: DataFrame, labels: list[int], radius: int = 1) -> DataFrame:
    """Each disc's mask grown by a square of the radius within the image; where two reach, the lower label; other labels are overgrown."""
    m = vox.where(F.col("label").isin(labels)).select(*REGION, "y", "x")
    m = _spread(_spread(m, "y", radius).distinct(), "x", radius).groupBy(*SLICE, "y", "x").agg(F.min("label").alias("__grown"))
    return vox.join(m, [*SLICE, "y", "x"], "left").withColumn("label", F.coalesce("__grown", "label")).drop("__grown")


def erode(vox: DataFrame, labels: list[int], radius: int = 1) -> DataFrame:
    """Each disc's mask shrunk by a square of the radius; what is lost gets label 0."""
    side = 2 * radius + 1
    m = vox.where(F.col("label").isin(labels)).select(*REGION, "y", "x")
    rows = _spread(m, "y", radius).groupBy(*REGION, "y", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == side)
    kept = _spread(rows.drop("n"), "x", radius).groupBy(*REGION, "y", "x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == side).select(*REGION, "y", "x", F.lit(True).alias("__kept"))
    joined = vox.join(kept, [*REGION, "y", "x"], "left")
    return joined.withColumn("label", F.when(F.col("label").isin(labels) & F.col("__kept").isNull(), 0).otherwise(F.col("label"))).drop("__kept")


def perturbed(vox: DataFrame, condition: str, labels: list[int], height: int, width: int, shift: tuple[int, int] = (1, 1), degrees: float = 5.0, sd: float = 5.0, radius: int = 1) -> DataFrame:
    """A named condition: dilation, erosion, translation, rotation, gaussian_noise, translation_rotation, dilation_trans_rot or erosion_trans_rot."""
    moved = lambda v: rotate(translate(v, *shift, height, width), degrees, height, width)
    jobs = {
        "dilation": lambda v: dilate(v, labels, radius),
        "erosion": lambda v: erode(v, labels, radius),
        "translation": lambda v: translate(v, *shift, height, width),
        "rotation": lambda v: rotate(v, degrees, height, width),
        "gaussian_noise": lambda v: noise(v, sd),
        "translation_rotation": moved,
        "dilation_trans_rot": lambda v: dilate(moved(v), labels, radius),
        "erosion_trans_rot": lambda v: erode(moved(v), labels, radius),
    }
    return jobs[condition](vox).withColumn("condition", F.lit(condition))


def gradients(vox: DataFrame) -> DataFrame:
    """Voxels with `magnitude` and `direction` of a 3x3 Sobel filter; at the border the image is mirrored without repeating its edge."""
    w = Window.partitionBy(*SLICE, "y").orderBy("x")
    v = lambda n: F.lag("intensity", n).over(w) if n > 0 else F.lead("intensity", -n).over(w)
    rows = vox.withColumns({"__l": F.coalesce(v(1), v(-1), F.col("intensity")), "__r": F.coalesce(v(-1), v(1), F.col("intensity"))})
    rows = rows.withColumns({"__dx": F.col("__r") - F.col("__l"), "__sx": F.col("__l") + 2 * F.col("intensity") + F.col("__r")})
    u = Window.partitionBy(*SLICE, "x").orderBy("y")
    at = lambda c, n: F.lag(c, n).over(u) if n > 0 else F.lead(c, -n).over(u)
    above = lambda c: F.coalesce(at(c, 1), at(c, -1), F.col(c))
    below = lambda c: F.coalesce(at(c, -1), at(c, 1), F.col(c))
    rows = rows.withColumns({"__gx": above("__dx") + 2 * F.col("__dx") + below("__dx"), "__gy": below("__sx") - above("__sx")})
    return rows.withColumns({"magnitude": F.sqrt(F.col("__gx") * F.col("__gx") + F.col("__gy") * F.col("__gy")), "direction": F.atan2("__gy", "__gx")}).drop("__l", "__r", "__dx", "__sx", "__gx", "__gy")


def direction_statistics(grad: DataFrame, labels: list[int], bins: int = 36) -> DataFrame:
    """(case_id, z, label, entropy, resultant, mean, sd, high, skew, kurtosis) of gradients in each region, in one pass: bins are counted beside the moments."""
    rows = grad.where(F.col("label").isin(labels))
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("direction") + math.pi) / (2 * math.pi) * bins)))
    rows = rows.select(*REGION, "magnitude", "direction", F.when(F.col("direction").isNotNull(), b).otherwise(bins).alias("__b"))
    counts = F.array(*[F.count_if(F.col("__b") == k) for k in range(bins + 1)]).alias("counts")
    m = rows.groupBy(*REGION).agg(
        F.count(F.lit(1)).alias("n"), counts, F.avg("magnitude").alias("mean"), F.stddev_pop("magnitude").alias("sd"), F.max("magnitude").alias("high"), F.skewness("magnitude").alias("skew"), F.kurtosis("magnitude").alias("kurtosis"), F.avg(F.cos("direction")).alias("c"), F.avg(F.sin("direction")).alias("s")
    )
    p = lambda c: c / F.col("n")
    entropy = -F.aggregate(F.filter("counts", lambda c: c > 0), F.lit(0.0), lambda t, c: t + p(c) * F.log2(p(c)))
    return m.select(*REGION, entropy.alias("entropy"), F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("resultant"), "mean", "sd", "high", "skew", "kurtosis")
