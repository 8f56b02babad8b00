"""Readers and writers of the jobs' tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..operators.reshape import grades_to_long


def clean_header(name: str) -> str:
    """Without a byte order mark and blanks around it."""
    return name.replace("﻿", "").strip()


def read_csv(spark: SparkSession, path) -> DataFrame:
    """Text columns with cleaned names; a name that comes twice is a ValueError."""
    rows = spark.read.option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)
    names = [clean_header(c) for c in rows.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names repeat: {sorted({n for n in names if names.count(n) > 1})}")
    return rows.toDF(*names)


def read_features(spark: SparkSession, path) -> DataFrame:
    """Wide feature table: trimmed case_id (required), all else numbers, null where they are none."""
    rows = read_csv(spark, path)
    if "case_id" not in rows.columns:
        raise ValueError("no column case_id")
    return rows.select(F.trim("case_id").alias("case_id"), *[keys.finite(F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "case_id"])


def chosen_columns(columns: list[str], drop: list[str] = (), keep: list[str] = (), drop_regex: str | None = None, keep_regex: str | None = None, order: str = "csv") -> list[str]:
    """Columns that stay, in the file's order or sorted; keep rules choose first, drop rules then remove."""
    out = [c for c in columns if (not keep and not keep_regex) or c in keep or (keep_regex and re.search(keep_regex, c))]
    out = [c for c in out if c not in drop and not (drop_regex and re.search(drop_regex, c))]
    if order not in ("csv", "sorted"):
        raise ValueError(f"order is 'csv' or 'sorted', not {order!r}")
    return sorted(out) if order == "sorted" else out


def read_model_input(spark: SparkSession, path, id_col: str, label_col: str | None = None, **rules) -> DataFrame:
    """(id, label, features…): unique ids and whole labels are required; features are numbers or null."""
    rows = read_csv(spark, path)
    features = chosen_columns([c for c in rows.columns if c not in (id_col, label_col)], **rules)
    out = rows.select(F.trim(id_col).alias(id_col), *([F.col(label_col).try_cast("int").alias(label_col)] if label_col else []), *[keys.finite(F.col(f"`{c}`")).alias(c) for c in features])
    again = out.groupBy(id_col).count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"{id_col} is not unique: {[r[id_col] for r in again]}")
    if label_col and not out.where(F.col(label_col).isNull()).isEmpty():
        raise ValueError(f"{label_col} has missing labels")
    return out


#: Names an id column may have.
ID_NAMES = ["case_id", "序号", "编号", "ID", "id"]


def read_grades(spark: SparkSession, path, segments: list[str] = keys.SEGMENTS, grade_col: str = "pfirrmann") -> DataFrame:
    """(case_id, segment, pfirrmann int) from a long or a wide table."""
    rows = read_csv(spark, path)
    id_col = next((c for c in ID_NAMES if c in rows.columns), None)
    if id_col is None:
        raise ValueError(f"no id column among {rows.columns}")
    if "segment" in rows.columns:
        long = rows.select(F.col(id_col).alias("case_id"), F.trim("segment").alias("segment"), F.col(grade_col).alias("grade"))
    else:
        long = grades_to_long(rows.withColumnRenamed(id_col, "case_id"), "case_id", segments)
    return long.where(F.col("segment").isin(segments)).select(keys.norm_id(F.col("case_id")).alias("case_id"), "segment", keys.grade_of(F.col("grade")).alias("pfirrmann"))


def read_statistics(spark: SparkSession, path, id_col: str = "image_id", order_col: str | None = None) -> DataFrame:
    """Scanner table, the first row of each normalised id; pixel_spacing is also parsed to an array.

    A file's rows are numbered as they are read; with several files give an order column.
    """
    rows = read_csv(spark, path).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.withColumn(id_col, keys.norm_id(F.col(id_col)))
    n = F.row_number().over(Window.partitionBy(id_col).orderBy(order_col or "__row"))
    out = rows.where(F.col(id_col).isNotNull()).withColumn("__n", n).where("__n = 1").drop("__n", "__row")
    return out.withColumn("spacing", F.from_json("pixel_spacing", "array<double>")) if "pixel_spacing" in out.columns else out


def read_predictions(spark: SparkSession, pattern: str) -> DataFrame:
    """All folds' prediction files, with the fold number of the path as it is there."""
    rows = spark.read.option("header", True).option("inferSchema", True).csv(pattern)
    return rows.withColumn("fold", F.regexp_extract(F.col("_metadata.file_path"), r"fold_(\d+)", 1).cast("int"))


def write_tables(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """A directory per table."""
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.option("header", True).csv if format == "csv" else writer.parquet)(f"{path}/{name}")


#: Marks of columns that are no features.
DIAGNOSTIC = re.compile(r"(_path|_status|_message|_time|_diagnostics?)$|^(diagnostics_|path_|status_)")


def feature_columns(columns: list[str]) -> list[str]:
    """Columns without paths, states and diagnostics; errors and numbers of valid slices stay only for the canal features."""
    out = []
    for c in columns:
        closing = re.search(r"_(error|valid_slices)$", c)
        if DIAGNOSTIC.search(c) or (closing and "dscr" not in c.lower()):
            continue
        out.append(c)
    return out


def write_summary(metrics: DataFrame, pooled: DataFrame, calibrated: DataFrame | None, path: str) -> DataFrame:
    """Per-fold metrics with the rows fold_mean, mean (pooled) and mean_calibrated; written as CSV and returned."""
    numbers = [f.name for f in metrics.schema if f.name != "fold" and f.dataType.simpleString() in ("double", "float", "bigint", "int")]
    rows = metrics.withColumn("fold", F.col("fold").cast("string"))
    rows = rows.unionByName(metrics.agg(*[F.avg(c).alias(c) for c in numbers]).withColumn("fold", F.lit("fold_mean")), allowMissingColumns=True)
    rows = rows.unionByName(pooled.withColumn("fold", F.lit("mean")), allowMissingColumns=True)
    if calibrated is not None:
        rows = rows.unionByName(calibrated.withColumn("fold", F.lit("mean_calibrated")), allowMissingColumns=True)
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return rows


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """A directory of JSON lines per table: summaries, thresholds, calibration reports. Arrays stay arrays, nulls are left out."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def pair_images(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(key, image, mask) of paths (column `path`) whose folder and bare name agree; of several masks the last path."""
    m = masks.groupBy(keys.pair_key(F.col("path"), mask=True).alias("key")).agg(F.max("path").alias("mask"))
    return images.select(keys.pair_key(F.col("path")).alias("key"), F.col("path").alias("image")).join(m, "key")


#: Suffixes of image files.
IMAGE_SUFFIXES = [".dcm", ".nii", ".nii.gz", ".nrrd", ".mha", ".mhd"]


def list_files(spark: SparkSession, root: str, suffixes: list[str] | None = None) -> DataFrame:
    """(path, file, length, modified): the files under a folder and all folders in it, `path` from the folder on; all suffixes if none are named.

    Spark lists the folders, many of them in parallel tasks, and on any file system that it reads; no file is opened. Empty files are
    left out, as by all of Spark's readers; a folder without files gives no rows.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = re.escape(re.sub(r"^\w+://[^/]*|^\w+:(?=/)", "", root).rstrip("/") + "/")
    rows = rows.select(F.regexp_extract("path", f"(?s)^.*?{below}(.*)$", 1).alias("path"), F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
    if suffixes:
        some = F.lit(False)
        for s in suffixes:
            some = some | F.endswith("path", F.lit(s))
        rows = rows.where(some)
    return rows


def pair_folders(spark: SparkSession, images: str, masks: str) -> DataFrame:
    """(case_id, folder, image, mask): files of two folder trees whose place and bare name agree, as paths from the trees' roots."""
    found = pair_images(list_files(spark, images, IMAGE_SUFFIXES), list_files(spark, masks, IMAGE_SUFFIXES))
    return found.select(F.regexp_extract("key", r"([^/]*)$", 1).alias("case_id"), F.regexp_replace("key", r"/?[^/]*$", "").alias("folder"), "image", "mask")


def list_folds(spark: SparkSession, root: str, name: str = "val_predictions.csv") -> DataFrame:
    """(fold, path): the prediction files under `root`, in folders fold_0, fold_1, ... at any depth."""
    rows = list_files(spark, root).where(F.regexp_extract("path", r"([^/]*)$", 1) == name)
    return rows.select(F.regexp_extract("path", r"(?:^|/)fold_(\d+)/", 1).try_cast("int").alias("fold"), "path").where(F.col("fold").isNotNull())
