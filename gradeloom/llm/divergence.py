"""Source divergence audit: how far the words of each source of a language are from those of the language's other sources.

Words are never cut out of the texts. Pointers to word starts are built over the Arrow buffer of a slice of texts and sorted by
multikey quicksort with eight bytes as one character: the pointers of a group are quicksorted by their next eight bytes, and only runs
of equal ones go on to the eight behind. The runs that are left equal are the slice's distinct words: their lengths are counts, and
the texts that they touch document frequencies. Slices' runs are added up by group and word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: A word is kept if so many documents of its language have it.
LEAST_DOCS = 30
#: Added to each count, and what shares are parts of.
PRIOR, UNIT = 5, 1_000_000_000
#: Bytes of text whose pointers are sorted at once; one longer text is a slice of its own.
SLICE_BYTES = 8_000_000
#: A cell of the pairs of sources: words (about) by sources of one tile, at most.
CELL_WORDS, TILE = 1024, 256
#: Groups, or languages, whose table may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Runs of pointers that are quicksorted one by one; more are sorted together, by run and key.
RUNS = 4096

#: The letter of each byte: A-Z lower-cased, other letters and all bytes beyond ASCII as they are, 0 for what is in no word.
_LETTER = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
#: The first 0 to 8 bytes of a key.
_FIRST = np.array([0, *((0xFFFFFFFFFFFFFFFF << (64 - 8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(1, 9))], np.uint64)


def _utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where its rows start and end in them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def word_pointers(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of the words: runs of letters that are not 0, cut where rows (bounds `at`, from 0) meet."""
    inside = letters != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(letters))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    start, row = np.flatnonzero(first), np.searchsorted(at, np.flatnonzero(first), side="right") - 1
    return start.astype(np.int32), (np.flatnonzero(last) + 1 - start).astype(np.int32), row.astype(np.int32)


def _quicksorted(key: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The order by run (ascending already) and key."""
    bounds = np.flatnonzero(np.diff(run, prepend=-1))
    if len(bounds) > RUNS:
        return np.lexsort((key, run))
    return np.concatenate([a + np.argsort(key[a:b]) for a, b in zip(bounds, [*bounds[1:], len(run)], strict=True)])


def equal_runs(letters: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): pointers sorted by group and word, and the places where a run of equal ones begins."""
    padded = np.concatenate([letters, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(letters) + 1, ">u8", padded, strides=(1,))  # the eight bytes from each place on
    order = np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable").astype(np.int32)
    fresh = np.zeros(len(order), bool)
    place, run, depth = np.arange(len(order), dtype=np.int32), group[order], 0
    while len(place):
        at = order[place]
        key = eight[start[at] + depth].astype(np.uint64) & _FIRST[np.clip(length[at] - depth, 0, 8)]
        by = _quicksorted(key, run)
        order[place], key = at[by], key[by]
        new = (np.diff(run, prepend=-1) != 0) | (np.diff(key, prepend=np.uint64(0)) != 0)
        fresh[place] |= new
        run = np.cumsum(new, dtype=np.int32)
        # a word of more bytes than were seen has no zero in its key; runs of one are settled
        more = (key & np.uint64(255) != 0) & (np.bincount(run)[run] > 1)
        place, run, depth = place[more], run[more], depth + 8
    return order, np.flatnonzero(fresh)


def _words(letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The bytes under the pointers, as a string column."""
    ends = np.cumsum(length, dtype=np.int64)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
    offsets = np.concatenate([np.zeros(1, np.int64), ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters[at]))


def _slices(at: np.ndarray):
    """Rows (a, b) of about SLICE_BYTES."""
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1)
        yield a, b
        a = b


def term_runs(batch: pa.RecordBatch):
    """Of a batch (lang, source, text): batches (lang, source, term, n, docs), one row per distinct word of a group in each slice of it."""
    data, at = _utf8(batch.column("text"))
    lang, source = (pc.fill_null(batch.column(c).cast(pa.string()), "").dictionary_encode() for c in ("lang", "source"))
    codes = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    for a, b in _slices(at):
        letters = _LETTER[data[at[a] : at[b]]]
        start, length, row = word_pointers(letters, at[a : b + 1] - at[a])
        if not len(start):
            continue
        groups, group = np.unique(codes[a:b], return_inverse=True)
        group = group.astype(np.int32)[row]
        order, first = equal_runs(letters, start, length, group)
        n = np.diff(np.append(first, len(order)))
        touched = np.sort(np.repeat(np.arange(len(first)), n) * (b - a) + row[order])  # run and row in one number
        touched = touched[np.diff(touched, prepend=-1) != 0]
        at_run = order[first]
        of = groups[group[at_run]]
        yield pa.RecordBatch.from_arrays(
            [
                lang.dictionary.take(pa.array(of // len(source.dictionary))),
                source.dictionary.take(pa.array(of % len(source.dictionary))),
                _words(letters, start[at_run], length[at_run]),
                pa.array(n.astype(np.int64)),
                pa.array(np.bincount(touched // (b - a), minlength=len(first)).astype(np.int64)),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each word in a source of a language, and the number of its documents that have it.

    Words are runs of ASCII letters and characters beyond ASCII, with A-Z in lower case. Null texts, languages and sources are
    empty; repeated rows count each; other columns are not read.
    """

    def found(batches):
        for batch in batches:
            yield from term_runs(batch)

    rows = docs.select(*[F.col(c).cast("string").alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    runs = rows.mapInArrow(found, "lang string, source string, term string, n long, docs long")
    return runs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + PRIOR) / (total + PRIOR * terms)), exact: products and the division are of 38 digits. 0 without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.call_function("div", (wide(n) + PRIOR) * F.lit(UNIT).cast("decimal(10,0)"), wide(total) + PRIOR * wide(terms))
    return F.when(terms > 0, 1 + over).otherwise(F.lit(0).cast("long"))


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast if few enough, else left to a shuffle join."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def audit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart.

    A language keeps the words that at least `least_docs` of its documents have; a source, and the language as a whole, gives each a share
    in parts of 10^9, smoothed by PRIOR. Part `pair`: for every other source of the language the summed difference of all shares. Part
    `term`: the `top` words that the source has and uses more than the language, by the difference. Ranks go by value, equal ones by item.

    Null and empty texts make a group without words, null languages and sources are ''. A language without kept words gives pairs of
    difference 0 and no words; a lone source has no pairs. Repeated rows count each; no rows give an empty result.
    """
    names = {"text_col": text_col, "lang_col": lang_col, "source_col": source_col}
    counts = saved(term_counts(docs, **names), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = saved(kept, "kept-terms")
    used = saved(counts.drop("docs").join(kept, ["lang", "term"]), "kept-counts")

    langs = saved(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all_n").alias("all_total")), "langs")
    empty = F.lit("")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source")).distinct()
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(_small(langs), "lang", "left").na.fill(0, ["total", "terms", "all_total"])
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = saved(groups.withColumn("none", _share(F.lit(0), F.col("total"), F.col("terms"))), "groups")

    shares = used.join(_small(groups), ["lang", "source"]).withColumn("share", _share(F.col("n"), F.col("total"), F.col("terms")))
    above = F.col("share") - _share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms = ranked(shares.withColumn("value", above).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")).where(F.col("rank") <= top)
    pairs = ranked(_pairs(shares, groups, kept.join(_small(langs), "lang")))
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").union(out(terms, "term"))


def _pairs(shares: DataFrame, groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed differences of the shares of each two sources of a language.

    The table of a language's words by its sources is cut into cells of about CELL_WORDS words by two tiles of TILE sources. A cell lists
    the shares above a count of 0, and, as rows without a word, each of its sources with the share of such a count.
    """
    blocks = F.floor(F.col("terms") / CELL_WORDS).cast("int") + 1
    cell = kept.select("lang", "term", F.pmod(F.hash("term"), blocks).alias("block"))
    cell = cell.withColumn("word", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    # how many tiles a language has; each source meets each of them
    sizes = _small(groups.groupBy("lang").agg(F.floor((F.count(F.lit(1)) - 1) / TILE).cast("int").alias("last")))
    rows = shares.join(cell, ["lang", "term"]).select("lang", "block", "word", "place", "share", F.lit(None).cast("string").alias("source"))
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("lang", "block", F.lit(-1).alias("word"), "place", F.col("none").alias("share"), "source")
    tile = F.floor(F.col("place") / TILE).cast("int")
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("last")), lambda t: F.struct(F.least(tile, t).alias("one"), F.greatest(tile, t).alias("other"))))
    tiled = rows.union(heads).join(sizes, "lang").withColumn("t", meets).select("lang", "block", "t.one", "t.other", "word", "place", "share", "source")

    def differences(frame):
        heads, cells = frame[frame["word"] < 0].sort_values("place"), frame[frame["word"] >= 0]
        one, other = int(frame["one"].iloc[0]), int(frame["other"].iloc[0])
        places = heads["place"].to_numpy()
        table = np.repeat(heads["share"].to_numpy()[None, :], int(cells["word"].max()) + 1 if len(cells) else 0, axis=0)
        table[cells["word"].to_numpy(), np.searchsorted(places, cells["place"].to_numpy())] = cells["share"].to_numpy()
        names = heads["source"].to_numpy()
        left, right = np.flatnonzero(places // TILE == one), np.flatnonzero(places // TILE == other)
        value = np.array([np.abs(table[:, right] - table[:, [a]]).sum(axis=0) for a in left], np.int64).reshape(len(left), len(right))
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        unlike = a != b
        out = pd.DataFrame({"lang": frame["lang"].iloc[0], "source": names[a], "item": names[b], "value": value.ravel()})[unlike]
        return out if one == other else pd.concat([out, out.rename(columns={"source": "item", "item": "source"})], ignore_index=True)

    parts = tiled.groupBy("lang", "block", "one", "other").applyInPandas(differences, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
