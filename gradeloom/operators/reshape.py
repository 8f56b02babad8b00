"""Wide feature tables to long ones and back, one-hot columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import SEGMENTS, base_case, condition_of, dummy_name, finite, name_part


def split_perturbed(rows: DataFrame) -> DataFrame:
    """Rows with base_case_id and condition from case_id."""
    return rows.withColumns({"base_case_id": base_case(F.col("case_id")), "condition": condition_of(F.col("case_id"))})


def wide_to_long(rows: DataFrame, keys: list[str], segments: list[str] = SEGMENTS, absent: bool = True) -> DataFrame:
    """(keys, segment, feature, value) from columns named <type>_<segment>_<name>; the segment part is cut out once, infinities are null.

    All columns go through one array and one explode, so thousands of columns are one narrow step. Without `absent`, a segment that has
    null in all its columns is one that the row lacks, and gives no rows.
    """
    cells, own = [], {}
    for c in rows.columns:
        if c in keys:
            continue
        for s in segments:
            if f"_{s}_" in c:
                cells.append(F.struct(F.lit(s).alias("segment"), F.lit(c.replace(f"_{s}_", "_", 1)).alias("feature"), finite(F.col(f"`{c}`")).alias("value")))
                own.setdefault(s, []).append(F.col(f"`{c}`"))
                break
    if absent:
        return rows.select(*keys, F.explode(F.array(*cells)).alias("e")).select(*keys, "e.*")
    there = F.array(*[F.when(F.coalesce(*columns).isNotNull(), F.lit(s)) for s, columns in own.items()])
    return rows.select(*keys, there.alias("__there"), F.explode(F.array(*cells)).alias("e")).where(F.array_contains("__there", F.col("e.segment"))).select(*keys, "e.*")


def export_by_level(rows: DataFrame, key: str, segments: list[str] = SEGMENTS) -> DataFrame:
    """One row per case and level: the level's columns without its name, and columns of no level on each of them. The wide rows are read once."""
    plain = [c for c in rows.columns if c != key and not any(f"_{s}_" in c for s in segments)]
    own = {s: {c.replace(f"_{s}_", "_", 1): c for c in rows.columns if f"_{s}_" in c} for s in segments}
    own = {s: columns for s, columns in own.items() if columns}
    if not own:
        return None
    names = list(dict.fromkeys(n for columns in own.values() for n in columns))
    level = lambda s: F.struct(F.lit(s).alias("Disc_Level"), *[(F.col(f"`{own[s][n]}`") if n in own[s] else F.lit(None)).alias(n) for n in names])
    parts = rows.select(F.col(key).alias("Sample_ID"), *[F.col(f"`{c}`") for c in plain], F.explode(F.array(*[level(s) for s in own])).alias("__e"))
    return parts.select("Sample_ID", "__e.Disc_Level", *[F.col(f"`{c}`") for c in plain], *[F.col(f"__e.`{n}`") for n in names])


#: How a segment may be written, in any case.
ALIASES = {s: [s, s.replace("-", ""), s.replace("-", "/"), s.replace("-L", "").replace("-", "")] for s in SEGMENTS}


def grade_columns(columns: list[str], segments: list[str]) -> dict[str, str]:
    """Column of each segment, whatever the case: an exact alias first, then a name that contains one; ValueError if there is none."""
    out = {}
    for s in segments:
        exact = [c for c in columns if c.strip().upper() in ALIASES[s]]
        inside = [c for c in columns if any(a in c.upper() for a in ALIASES[s])]
        if not exact and not inside:
            raise ValueError(f"no grade column for {s} among {columns}")
        out[s] = (exact or inside)[0]
    return out


def grades_to_long(rows: DataFrame, key: str, segments: list[str]) -> DataFrame:
    """(key, segment, grade text)"""
    cols = grade_columns([c for c in rows.columns if c != key], segments)
    cells = F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"`{c}`").cast("string").alias("grade")) for s, c in cols.items()])
    return rows.select(key, F.explode(cells).alias("e")).select(key, "e.*")


def one_hot(rows: DataFrame, column: str, levels: list, prefix: str = "seg") -> DataFrame:
    """A 0/1 column per level; a null or other value has 0 in all."""
    return rows.withColumns({f"{prefix}_{name_part(v)}": F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0) for v in levels})


def only_levels(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Rows of the levels; ValueError if none remain."""
    out = rows.where(F.col(column).isin(levels))
    if out.isEmpty():
        raise ValueError(f"no row has {column} among {levels}")
    return out


def one_hot_cases(rows: DataFrame, cases: DataFrame, key: str, column: str, drop_first: bool = False, missing: str = "error", prefix: str = "") -> DataFrame:
    """Dummy columns of a case column, for its sorted distinct levels. Cases without a value: ValueError, or the level UNKNOWN."""
    if missing not in ("error", "UNKNOWN"):
        raise ValueError(f"missing is 'error' or 'UNKNOWN', not {missing!r}")
    joined = rows.join(cases.select(key, F.col(column).cast("string").alias("__v")), key, "left")
    if missing == "error":
        lost = joined.where(F.col("__v").isNull()).select(key).limit(1).collect()
        if lost:
            raise ValueError(f"{key} {lost[0][key]!r} has no {column}")
    joined = joined.withColumn("__v", F.coalesce("__v", F.lit("UNKNOWN")))
    levels = [r["__v"] for r in joined.select("__v").distinct().orderBy("__v").collect()][int(drop_first) :]
    names = [dummy_name(column, v, prefix) for v in levels]
    clash = {n for n in names if n in rows.columns or names.count(n) > 1}
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return joined.withColumns({n: F.when(F.col("__v") == v, 1.0).otherwise(0.0) for n, v in zip(names, levels, strict=True)}).drop("__v")


def forced_rows(long: DataFrame, forced: DataFrame, names: list[str]) -> DataFrame:
    """Selected rows and those of forced features that were not selected."""
    more = forced.where(F.col("feature").isin(names)).join(long.select("feature").distinct(), "feature", "left_anti")
    return long.unionByName(more)


def first_per_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__n", n).where("__n = 1").drop("__n")
