"""Image jobs on one slice per row: pixels and labels as arrays, row by row, so that a pixel's neighbours are in its own row.

Making slices of voxels is the one shuffle; what follows works on some slices at a time, with shifts, running maxima and stencils of whole arrays in
place of joins and windows of neighbours. A slice is what a task must hold. Where a slice has no voxel, its pixel is NaN and its label -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs

SLICE = ["case_id", "z"]
ABSENT = -1
#: Pixels that are worked on at once, or one slice if it has more.
HELD = 1 << 18
_COLUMNS = "case_id long, z int, height int, width int, pixels array<double>, labels array<int>"


def to_slices(vox: DataFrame, height: int, width: int) -> DataFrame:
    """(case_id, z, height, width, pixels, labels) of voxels (case_id, z, y, x, intensity, label); voxels outside of the image are left out, of two at a place the last by label and intensity stays."""
    size = height * width

    def lay(frames):
        for frame in runs.whole(frames, SLICE):
            first = runs.starts(frame, SLICE)
            ends = np.append(first[1:], len(frame))
            at = (frame["y"] * width + frame["x"]).to_numpy()
            for a in range(0, len(first), step := max(1, HELD // size)):
                some, begin = slice(first[a], ends[min(a + step, len(first)) - 1]), first[a : a + step]
                where = np.repeat(np.arange(len(begin)) * size, ends[a : a + step] - begin) + at[some]
                pixels, labels = np.full(len(begin) * size, np.nan), np.full(len(begin) * size, ABSENT, np.int32)
                pixels[where], labels[where] = frame["intensity"].to_numpy(float)[some], frame["label"].to_numpy()[some]
                yield frame[SLICE].iloc[begin].assign(height=height, width=width, pixels=list(pixels.reshape(-1, size)), labels=list(labels.reshape(-1, size)))

    inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
    rows = vox.where(inside).select(*SLICE, "y", "x", "intensity", "label")
    return runs.gathered(rows, SLICE, F.asc_nulls_last("label"), F.asc_nulls_last("intensity")).mapInPandas(lay, _COLUMNS)


def to_voxels(slices: DataFrame, *more: str) -> DataFrame:
    """(case_id, z, y, x, intensity, label, more): a row for every voxel that is there; `more` names further arrays."""
    at = F.posexplode(F.arrays_zip("pixels", "labels", *more)).alias("at", "v")
    rows = slices.select(*SLICE, "width", at).where(F.col("v.labels") != ABSENT)
    y, x = F.floor(F.col("at") / F.col("width")).cast("int"), (F.col("at") % F.col("width")).cast("int")
    return rows.select(*SLICE, y.alias("y"), x.alias("x"), F.col("v.pixels").alias("intensity"), F.col("v.labels").alias("label"), *[F.col(f"v.{c}").alias(c) for c in more])


def _each(slices: DataFrame, work, more: str = "") -> DataFrame:
    """`work(pixels, labels)`, of stacks of images of one size, makes a dictionary of new stacks; `more` declares the arrays that slices don't have yet."""

    def run(frames):
        for frame in frames:
            for (h, w), same in frame.groupby(["height", "width"], sort=False):
                step = max(1, HELD // max(1, h * w))
                for a in range(0, len(same), step):
                    some = same.iloc[a : a + step]
                    stack = lambda c, kind: np.stack(list(some[c])).astype(kind, copy=False).reshape(-1, h, w)  # noqa: B023, E731
                    yield some.assign(**{k: list(x.reshape(len(some), -1)) for k, x in work(stack("pixels", float), stack("labels", np.int32)).items()})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slices.schema)
    return slices.mapInPandas(run, schema + (f", {more}" if more else ""))


def _shifted(image: np.ndarray, dy: int, dx: int, fill) -> np.ndarray:
    """Images (the last two axes) moved by whole pixels; `fill` where nothing comes from."""
    h, w = image.shape[-2:]
    out = np.full_like(image, fill)
    if abs(dy) < h and abs(dx) < w:
        out[..., max(dy, 0) : h + min(dy, 0), max(dx, 0) : w + min(dx, 0)] = image[..., max(-dy, 0) : h + min(-dy, 0), max(-dx, 0) : w + min(-dx, 0)]
    return out


def _square(mask: np.ndarray, radius: int, grow: bool) -> np.ndarray:
    """The mask grown or shrunk by a square, one direction after the other; outside of the image is no mask."""
    for axis in (0, 1):
        shifts = [_shifted(mask, *((k, 0) if axis == 0 else (0, k)), False) for k in range(-radius, radius + 1)]
        mask = np.logical_or.reduce(shifts) if grow else np.logical_and.reduce(shifts)
    return mask


def translate(slices: DataFrame, dy: int, dx: int) -> DataFrame:
    """Slices moved by whole pixels; what leaves the image goes, and places without a voxel are absent."""
    return _each(slices, lambda p, v: {"pixels": _shifted(p, dy, dx, np.nan), "labels": _shifted(v, dy, dx, ABSENT)})


def dilate(slices: DataFrame, labels: list[int], radius: int = 1) -> DataFrame:
    """Each disc's mask grown by a square of the radius within the voxels that are there; where two reach, the lower label; other labels are overgrown."""

    def work(p, v):
        out = v.copy()
        for label in sorted(labels, reverse=True):
            out[_square(v == label, radius, True) & (v != ABSENT)] = label
        return {"labels": out}

    return _each(slices, work)


def erode(slices: DataFrame, labels: list[int], radius: int = 1) -> DataFrame:
    """Each disc's mask shrunk by a square of the radius; what is lost gets label 0."""

    def work(p, v):
        out = v.copy()
        for label in labels:
            mask = v == label
            out[mask & ~_square(mask, radius, False)] = 0
        return {"labels": out}

    return _each(slices, work)


def gradients(slices: DataFrame) -> DataFrame:
    """Slices with arrays `magnitude` and `direction` of a 3x3 Sobel filter; at the border the image is mirrored without repeating its edge. An absent neighbour makes both NaN."""

    def work(p, v):
        padded = p
        for axis in (1, 2):
            padded = np.pad(padded, [(1, 1) if a == axis else (0, 0) for a in (0, 1, 2)], mode="reflect" if p.shape[axis] > 1 else "edge")
        dx = padded[..., 2:] - padded[..., :-2]
        sx = padded[..., :-2] + 2 * padded[..., 1:-1] + padded[..., 2:]
        gx, gy = dx[:, :-2] + 2 * dx[:, 1:-1] + dx[:, 2:], sx[:, 2:] - sx[:, :-2]
        return {"magnitude": np.sqrt(gx * gx + gy * gy), "direction": np.arctan2(gy, gx)}

    return _each(slices, work, "magnitude array<double>, direction array<double>")


def box_counts(slices: DataFrame, over: float, least: int = 1, most: int | None = None) -> DataFrame:
    """(case_id, z, box, n): boxes of side 1, 2, 4, … up to min(max(h, w) // 4, 128) that hold a pixel over the level; boxes of none give no row."""

    def run(frames):
        for frame in frames:
            out = []
            for case, z, h, w, p in zip(frame["case_id"], frame["z"], frame["height"], frame["width"], frame["pixels"], strict=True):
                y, x = np.nonzero(np.asarray(p, float).reshape(h, w) > over)
                box, top = least, most or min(max(h, w) // 4, 128)
                while box <= top and len(y):
                    out.append((case, z, box, len(np.unique((y // box) * w + x // box))))
                    box *= 2
            yield pd.DataFrame(out, columns=["case_id", "z", "box", "n"])

    return slices.select(*SLICE, "height", "width", "pixels").mapInPandas(run, "case_id long, z int, box int, n long")
