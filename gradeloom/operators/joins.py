"""Attaching grades and case tables, restricting and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = ["case_id", "segment"]


def attach_grade(rows: DataFrame, grades: DataFrame, missing: str = "error") -> DataFrame:
    """Rows with the grade of their (case_id, segment). Without one, or with a null one: ValueError, or with missing="drop" the row goes."""
    known = grades.where(F.col("pfirrmann").isNotNull())
    if missing != "drop":
        lost = rows.join(known, SAMPLE, "left_anti").select(*SAMPLE).limit(10).collect()
        if lost:
            raise ValueError(f"no grade for {[tuple(r) for r in lost]}")
    return rows.join(known, SAMPLE)


def grade_series(index: DataFrame, grades: DataFrame) -> DataFrame:
    """(case_id, segment, pfirrmann double) for every row of `index`, whatever its other columns.

    ValueError with their number if samples have no grade or a null one, and with some of them if a sample has several.
    """
    known = grades.where(F.col("pfirrmann").isNotNull()).select(*SAMPLE, F.col("pfirrmann").cast("double").alias("pfirrmann"))
    wanted = index.select(*SAMPLE)
    again = known.groupBy(*SAMPLE).count().where("count > 1").join(wanted, SAMPLE, "left_semi").limit(10).collect()
    if again:
        raise ValueError(f"several grades for {[tuple(r[c] for c in SAMPLE) for r in again]}")
    series = wanted.join(known, SAMPLE, "left")
    lost = series.where(F.col("pfirrmann").isNull()).count()
    if lost:
        raise ValueError(f"{lost} samples have no grade")
    return series


def attach_case(rows: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Case columns for each row; Spark broadcasts the case table only while it is small."""
    return rows.join(cases, key, "left")


def only_patients(rows: DataFrame, patients: DataFrame, key: str) -> DataFrame:
    return rows.join(patients.select(key).distinct(), key, "left_semi")


def uncovered(rows: DataFrame, cases: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The first ids that the case table lacks."""
    return rows.select(key).distinct().join(cases, key, "left_anti").orderBy(key).limit(limit)


def merge_features(first: DataFrame, second: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of both by key; where both have a value that of the second holds."""
    a, b = first.alias("a"), second.alias("b")
    shared = [c for c in first.columns if c in second.columns and c != key]
    out = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in first.columns:
        if c != key:
            out.append(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in shared else F.col(f"a.{c}"))
    out += [F.col(f"b.{c}") for c in second.columns if c != key and c not in first.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(*out)
