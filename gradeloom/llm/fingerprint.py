"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct shingle hashes of a text. Sketches of the parts of
a text set merge by union, and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sample_bound, saved

K = 128
WORDS = 5
#: About so many ids share a window group; a group is what is sorted at once, and a task has TASK_ROWS rows of them.
GROUP_ROWS, TASK_ROWS = 1024, 4096
#: Ranges of ids: FANOUT coarse ones of FANOUT fine ones at most (beyond a billion ids they grow), each drawn from SAMPLED ids.
FANOUT, SAMPLED = 1024, 20


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once: a lambda's argument isn't copied into the places that use it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hashes of all runs of `words` words, lower-cased; of the whole sequence if it is shorter; none if it is empty."""
    listed = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != F.lit(""))
    return let(
        listed,
        lambda ws: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(ws) - (words - 1), F.least(F.size(ws), F.lit(1))), F.lit(1)),
            lambda i: F.xxhash64(F.slice(ws, i, words)),
        ),
    )


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """Bottom-k sketch; null and wordless texts have an empty one."""
    some = F.coalesce(text, F.lit("")).rlike(r"\S")
    return F.when(some, F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)).otherwise(F.array().cast("array<bigint>"))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of what `a` and `b` sketch."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets; 1 if both are empty."""
    return let(
        merged(a, b, k),
        lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)),
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a is empty."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_sketches(rows: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    Hashes are counted out per key and the smallest k kept: the parts are combined before the shuffle, never listed whole.
    """
    hashes = rows.select(*keys, F.explode_outer(sketch_col).alias("__h")).groupBy(*keys, "__h").agg(F.lit(1).alias("__one"))
    ranked = hashes.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("__h").asc_nulls_last()))).where(F.col("__rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(sketch_col))


def text_in_name(parts: Column) -> Column:
    """A sketch as text: its hashes in decimal, ascending, joined by blanks."""
    return F.array_join(parts.cast("array<string>"), " ")


def _ranges(keys: DataFrame, rows: int) -> tuple[list, DataFrame]:
    """Bounds that cut `key` into ranges of about `rows` keys: coarse ones, a list, and (coarse, fine) with each coarse range's own.

    They are drawn from a hashed sample of SAMPLED keys a range, so they follow the keys' counts, not their values. Every bound is
    a key, and the least key sampled is none, so no range is empty. At most FANOUT coarse ranges of FANOUT fine ones.
    """
    n = keys.count()
    coarse = min(FANOUT, max(1, math.isqrt(n // rows) + 1))
    hashed = F.shiftrightunsigned(F.xxhash64("key", F.lit(29)), 1)

    def drawn(wanted: int) -> DataFrame:
        return keys.where(hashed < F.lit(sample_bound(n, wanted))) if wanted < n else keys

    def cut(listed: Column, parts: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.size(listed) / parts).cast("int"))
        return F.filter(F.array_distinct(F.filter(listed, lambda x, i: (i > 0) & (i % step == 0))), lambda x: x > F.try_element_at(listed, F.lit(1)))

    sample = drawn(coarse * SAMPLED).agg(F.sort_array(F.collect_list("key")).alias("l"))
    bounds = sample.select(cut(F.col("l"), F.lit(coarse)).alias("b")).first()["b"] or []
    fine = min(FANOUT, max(1, n // rows // (len(bounds) + 1) + 1))
    placed = drawn((len(bounds) + 1) * fine * SAMPLED).withColumn("coarse", _place(F.col("key"), _listed(keys, bounds)))
    return bounds, placed.groupBy("coarse").agg(F.sort_array(F.collect_list("key")).alias("l")).select("coarse", cut(F.col("l"), F.lit(fine)).alias("fine"))


def _listed(keys: DataFrame, bounds: list) -> Column:
    """`bounds` as a column of the keys' own type."""
    kind = T.ArrayType(keys.schema["key"].dataType)
    parts = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, kind.elementType.fields, strict=True)]) for b in bounds])
    return parts.cast(kind)


def _place(key: Column, bounds: Column) -> Column:
    """How many of the ascending bounds, 2 * FANOUT - 1 at most, are not over the key, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(FANOUT.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(bounds, at + step) <= key, at + step).otherwise(at))


def with_next(docs: DataFrame, id_col: str, carried: list[str], prefix: str, tie_col: str = "text") -> DataFrame:
    """Each row with the `carried` columns of the next row in descending id order as `<prefix><column>`; the last row's next is the first.

    Rows are dealt to ranges that follow the ids' counts, so that no task sorts more than a few ranges. The first row of each range
    is also sent to the range above it, where it closes the gap. Ids of any type that has an order will do. Null ids come last; rows
    with equal ids follow by the hash of `tie_col`.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(tie_col).alias("tie"))
    keys = saved(docs.select(key.alias("key")), "keys")
    n = keys.count()
    bounds, fines = _ranges(keys, GROUP_ROWS)
    fines = saved(fines, "ranges")

    def ranged(rows: DataFrame) -> DataFrame:
        """`rows`, which have a `__key`, with its `__range`."""
        rows = rows.withColumn("__coarse", _place(F.col("__key"), _listed(keys, bounds)))
        # a row a coarse range, FANOUT at most, and FANOUT keys in each at most
        rows = rows.join(F.broadcast(fines), F.col("__coarse") == F.col("coarse"), "left")
        fine = F.when(F.col("fine").isNull(), 0).otherwise(_place(F.col("__key"), F.col("fine")))
        return rows.withColumn("__range", F.col("__coarse").cast("long") * (2 * FANOUT) + fine).drop("coarse", "fine", "__coarse")

    heads = saved(ranged(keys.withColumnRenamed("key", "__key")).groupBy("__range").agg(F.max("__key").alias("__head")), "heads")
    # ranges are FANOUT squared at most, and their order is all the driver sees
    order = [r["__range"] for r in heads.select("__range").orderBy("__range").collect()]
    above = heads.sparkSession.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "__range long, __to long")
    heads = heads.join(F.broadcast(above), "__range").select("__head", "__to")
    guests = ranged(docs.withColumn("__key", key)).join(F.broadcast(heads), F.col("__key") == F.col("__head"), "left")
    own, guest = (F.struct(F.col(c).alias("range"), F.lit(g).alias("guest")) for c, g in (("__range", False), ("__to", True)))
    dealt = guests.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    dealt = dealt.select(*docs.columns, "__key", F.col("__at.range").alias("__range"), F.col("__at.guest").alias("__guest"))
    dealt = dealt.repartition(max(1, -(-n // TASK_ROWS)), "__range")
    # one lead for all that is carried: one sort, one shuffle
    window = Window.partitionBy("__range").orderBy("__guest", F.desc_nulls_last("__key"))
    led = dealt.withColumn("__next", F.lead(F.struct(*carried)).over(window)).where(~F.col("__guest"))
    return led.select(*docs.columns, *[F.col(f"__next.{c}").alias(prefix + c) for c in carried])


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprint every text and its edited text.

    The edited text is the text with its last floor(n/3) code points replaced by the first as many (or all) of the next
    row's in descending id order. Ids may be of any type that has an order. Null texts count as empty, null ids come last; an empty
    table gives an empty result; repeated rows a row each; columns other than the two named are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("sketch", sketch(F.col("text"), k, words))
    rows = with_next(base, "id", ["text", "sketch"], "next_")
    n = F.char_length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 3).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 3).cast("int")))
    rows = rows.select("id", "sketch", "next_sketch", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.select("*", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited"), k, words).alias("edited_sketch"))
    return rows.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        text_in_name(F.col("sketch")).alias("fingerprint"),
        text_in_name(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
    )
