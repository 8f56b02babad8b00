"""Removal of lines that many sites share, in DataFrame functions only.

Every line is hashed; a HyperLogLog sketch of the sites per hash merges by aggregation. Lines whose estimate is clearly over
the threshold are boilerplate, lines near it are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import masked, saved, unmasked
from .fingerprint import let

SITES = 8
#: log2 of the sketch's registers: a standard error of about 1.6 %.
LG_K = 12
#: Lines within this share of the threshold get an exact count: over six standard errors.
MARGIN = 0.15
#: Boilerplate hashes that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 500_000


#: A line's key: two hashes of the line without blanks around it, in lower case.
KEY = ["hash", "hash2"]


def keyed_lines(rows: DataFrame) -> DataFrame:
    """`rows` with the key of their `line` in its place; blank lines, which are never boilerplate, go.

    Lines are told apart by the key's 96 bits: among 10^12 distinct lines two meet with a chance of about 10^-5.
    """
    bare = rows.withColumn("line", F.lower(F.trim("line"))).where("line <> ''")
    return bare.withColumns({"hash": F.xxhash64("line"), "hash2": F.hash("line")}).drop("line")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(hash, hash2, first_id): keys of lines found on at least `sites` distinct sites, and the least id that has one. Null sites do not count."""
    lines = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.explode(_lines(F.col(text_col))).alias("line"))
    lines = keyed_lines(lines.where(F.col("site").isNotNull()))
    # Each task sketches its own lines, so a hot line is one row per task in the shuffle.
    some = lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("id").alias("first_id"))
    some = some.select(*KEY, "first_id", F.hll_sketch_estimate("sketch").alias("estimate"))
    some = saved(some.where(F.col("estimate") >= sites * (1 - margin)), "spread")
    sure = some.where(F.col("estimate") > sites * (1 + margin)).select(*KEY, "first_id")
    near = some.where(F.col("estimate") <= sites * (1 + margin)).select(*KEY)
    exact = lines.join(_small(near), KEY, "left_semi").groupBy(*KEY).agg(F.count_distinct("site").alias("n"), F.min("id").alias("first_id")).where(F.col("n") >= sites)
    return saved(sure.union(exact.select(*KEY, "first_id")), "boilerplate")


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast if few enough, else left to a shuffle join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, keep_first: bool = True) -> DataFrame:
    """`docs` with columns __lines, __removed (numbers of lines, of removed ones) and __text, the text that is left.

    Boilerplate lines go from every document but, with keep_first, that with the least id which has them. Null and empty texts,
    blank lines and rows whose site is null but whose lines are not boilerplate stay as they are. Repeated rows are alike. Other columns
    are carried whatever their names; one named like a new column gives way to it. An empty table gives an empty result.
    """
    rows, i, t, site = masked(docs, id_col, text_col, site_col)
    return unmasked(_cleaned(rows, i, t, site, sites, keep_first), docs.columns, "__lines", "__removed", "__text")


def strip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, keep_first: bool = True, n_chars_col: str | None = None) -> DataFrame:
    """`docs` with boilerplate lines taken out of the text, in the columns it came with, and `n_chars_col`, if named, counted anew.

    Rows of which no visible character is left go; rows without boilerplate stay as they are, null and empty texts too.
    """
    rows, i, t, site, *n = masked(docs, id_col, text_col, site_col, *([n_chars_col] if n_chars_col else []))
    out = _cleaned(rows, i, t, site, sites, keep_first)
    hit = F.col("__removed") > 0
    new = {t: F.col("__text")} | {c: F.when(hit, F.char_length("__text").cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in n}
    out = out.where(~hit | F.col("__text").rlike(r"\S"))
    return unmasked(out.select(*[new.get(c, F.col(c)).alias(c) for c in rows.columns]), docs.columns)


def _cleaned(docs: DataFrame, id_col: str, text_col: str, site_col: str, sites: int, keep_first: bool) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Rows are known by id and text, so nothing depends on where a row lies; equal rows lose equal lines.
    keyed = docs.withColumn("__id", F.col(id_col)).withColumn("__hash", F.xxhash64(text))
    found = boilerplate(docs, id_col=id_col, text_col=text_col, site_col=site_col, sites=sites)
    lines = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    hit = keyed_lines(lines).join(_small(found), KEY)
    if keep_first:
        hit = hit.where(~F.col("__id").eqNullSafe(F.col("first_id")))
    gone = hit.groupBy("__id", "__hash").agg(F.collect_set("pos").alias("__gone")).withColumnsRenamed({"__id": "__id2", "__hash": "__hash2"})
    out = keyed.join(gone, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__hash") == F.col("__hash2")), "left")
    listed = _lines(F.col(text_col))
    # positions that stay, by one pass over a hash set of those that go
    stay = F.array_except(F.sequence(F.lit(0), F.size(listed) - 1), F.col("__gone"))
    left = F.array_join(let(listed, lambda lines: F.transform(stay, lambda i: F.get(lines, i))), "\n")
    return out.select(
        *docs.columns,
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(listed)).cast("long").alias("__lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__removed"),
        F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left).alias("__text"),
    )
