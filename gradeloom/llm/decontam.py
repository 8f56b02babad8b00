"""Benchmark decontamination: windows of benchmark words looked up in the words of every document.

Texts are scanned as UTF-8 bytes: A-Z are lower-cased and a word is a run of ASCII digits, letters and
non-ASCII characters. Windows of `n` consecutive item words go to executors as a sorted table of hashes;
a hash that is met is verified by comparing the words themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import masked, rows_in, saved, unmasked

WINDOW = 10
#: Windows that are broadcast whole (some 100 bytes each). Of more, a bit table is.
BLOCK_WINDOWS = 500_000
#: Documents with hits whose spans may be broadcast; more are joined by a shuffle.
HIT_ROWS = 100_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _Words:
    """Words of a byte string: their places and 64-bit hashes."""

    _powers = _powers(_BASE, 1 << 8)

    def __init__(self, data: bytes):
        self.data = _LOWER[np.frombuffer(data, np.uint8)]
        inside = _IN_WORD[self.data]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        size = self.end - self.start
        if len(size) and size.max() > len(_Words._powers):
            _Words._powers = _powers(_BASE, 2 * int(size.max()))
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        raw = np.add.reduceat((self.data[inside].astype(np.uint64) + np.uint64(1)) * self._powers[place], first) if len(size) else np.zeros(0, np.uint64)
        raw ^= raw >> np.uint64(31)
        self.hashes = raw * np.uint64(_STEP)

    def windows(self, n: int) -> np.ndarray:
        """Hash of each run of n words."""
        if len(self.hashes) < n:
            return np.zeros(0, np.uint64)
        total = np.zeros(len(self.hashes) - n + 1, np.uint64)
        for j in range(n):
            total = total * np.uint64(_BASE) + self.hashes[j : len(self.hashes) - n + 1 + j]
        return total ^ (total >> np.uint64(29))

    def run(self, i: int, n: int) -> bytes:
        """The words i to i+n-1, joined by blanks."""
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i : i + n], self.end[i : i + n], strict=True))


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int = WINDOW) -> DataFrame:
    """(length, hash, words, item): every distinct window of every item; an item of 1 to n-1 words is one window."""

    def cut(frames):
        for frame in rows_in(frames, rows=100):
            out = []
            for item, text in zip(frame["item"], frame["text"], strict=True):
                words = _Words((text or "").encode())
                size = min(n, len(words.start))
                if size and item is not None:
                    out += [(size, int(h), words.run(i, size), item) for i, h in enumerate(words.windows(size).astype(np.int64))]
            yield pd.DataFrame(out, columns=["length", "hash", "words", "item"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return items.mapInPandas(cut, "length int, hash long, words binary, item string").distinct()


@dataclass
class _Block:
    """Windows by their length: sorted hashes, a bit table that most absent hashes fail, and the exact words of each hash."""

    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    items: dict[bytes, list[str]]

    @staticmethod
    def of(rows: pd.DataFrame) -> _Block:
        tables = {}
        for length, part in rows.groupby("length"):
            hashes = np.unique(part["hash"].to_numpy(dtype=np.int64).astype(np.uint64))
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            tables[int(length)] = (hashes, bits)
        items: dict[bytes, list[str]] = {}
        for words, item in zip(rows["words"], rows["item"], strict=True):
            items.setdefault(bytes(words), []).append(item)
        return _Block(tables, items)


def _scan(texts: list[bytes], block: _Block) -> list[tuple[int, list[tuple[int, int]], list[str], list[tuple[int, int]]]]:
    """Per text: number of words, merged spans of hit words, items met, and the spans in bytes."""
    joined = _Words(b"\n".join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(joined.start, ends)  # words before each text's end
    first = np.concatenate(([0], last[:-1]))
    found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
    for length, (hashes, bits) in block.tables.items():
        got = joined.windows(length)
        maybe = np.flatnonzero(bits[(got >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(hashes, got[maybe]), len(hashes) - 1)
        maybe = maybe[hashes[place] == got[maybe]]
        for i, k in zip(maybe.tolist(), np.searchsorted(last, maybe, side="right").tolist(), strict=True):
            if i + length > last[k]:
                continue  # it would run into the next text
            if items := block.items.get(joined.run(i, length)):
                spans, met = found.setdefault(k, ([], set()))
                spans.append((i, i + length))
                met.update(items)
    out = []
    for k in range(len(texts)):
        spans, met = found.get(k, ([], set()))
        merged = merge_spans(spans)
        at = int(ends[k]) - len(texts[k]) - 1
        out.append((int(last[k] - first[k]), [(a - int(first[k]), b - int(first[k])) for a, b in merged], sorted(met), [(int(joined.start[a]) - at, int(joined.end[b - 1]) - at) for a, b in merged]))
    return out


def merge_spans(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, spans array<array<int>>, items array<string>, bytes array<array<int>>"


def _lookup(shared):
    @F.pandas_udf(FOUND)
    def look(text: pd.Series) -> pd.DataFrame:
        rows = []
        for piece in rows_in([text.to_frame("text")], size=2_000_000):
            rows += _scan([(t or "").encode("utf-8", "surrogatepass") for t in piece["text"]], shared.value)
        return pd.DataFrame(rows, columns=["n_words", "spans", "items", "bytes"])

    return look


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, block_windows: int = BLOCK_WINDOWS, as_col: str = "found") -> DataFrame:
    """`docs` with a column of structs: n_words, merged spans of hit words [from, to), item ids met, and the spans in bytes of the UTF-8 text.

    Null and wordless texts have no words and no hits. An empty benchmark hits nothing; items with null id or text are none.
    Up to `block_windows` windows are broadcast whole. Of more, a bit table of bounded size is: the document windows that pass it
    meet the benchmark's in a join, so the documents are read once however long the benchmark. All columns of `docs` stay, but one
    named `as_col` gives way; repeated rows are scanned alike.
    """
    spark = docs.sparkSession
    windows = saved(item_windows(benchmark, item_col, item_text_col, n), "windows")
    plain, t = masked(docs, text_col)
    if windows.count() <= block_windows:
        shared = spark.sparkContext.broadcast(_Block.of(windows.toPandas()))
        found = plain.withColumn(as_col, _lookup(shared).asNondeterministic()(F.col(t)))  # run once, wherever its fields are used
    else:
        found = _scan_by_join(plain, t, windows, as_col)
    return unmasked(found, docs.columns, as_col)


#: Bits of the table that windows of a long benchmark leave: 32 MB.
TABLE_BITS = 28
_WORD_BITS = 18  # bits of the table in one row of its making


def _bit_table(windows: DataFrame) -> np.ndarray:
    """One bit for each value of the windows' first TABLE_BITS hash bits. It is made by parts of a bounded size."""

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _WORD_BITS, np.uint8)
        bits[frame["slot"].to_numpy() & ((1 << _WORD_BITS) - 1)] = 1
        return pd.DataFrame({"part": [int(frame["slot"].iloc[0]) >> _WORD_BITS], "bits": [np.packbits(bits).tobytes()]})

    slots = windows.select(F.shiftrightunsigned("hash", 64 - TABLE_BITS).alias("slot")).distinct()
    parts = slots.groupBy(F.shiftright("slot", _WORD_BITS)).applyInPandas(fill, "part int, bits binary").toArrow()
    out = np.zeros((1 << (TABLE_BITS - _WORD_BITS), 1 << (_WORD_BITS - 3)), np.uint8)
    for part, bits in zip(parts["part"].to_pylist(), parts["bits"].to_pylist(), strict=True):
        out[part] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _scan_by_join(docs: DataFrame, text_col: str, windows: DataFrame, as_col: str) -> DataFrame:
    lengths = [r["length"] for r in windows.select("length").distinct().collect()]  # as many as a window has words
    shared = docs.sparkSession.sparkContext.broadcast((_bit_table(windows), lengths))

    @F.pandas_udf("n_words long, hits array<struct<length int, at int, hash long, words binary>>")
    def maybe(text: pd.Series) -> pd.DataFrame:
        bits, lengths = shared.value
        rows = []
        for t in text:
            words = _Words((t or "").encode("utf-8", "surrogatepass"))
            hits = []
            for length in lengths:
                got = words.windows(length)
                slot = (got >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
                passed = np.flatnonzero(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
                hits += [(length, int(i), int(got[i].view(np.int64)), words.run(int(i), length)) for i in passed]
            rows.append((len(words.start), hits))
        return pd.DataFrame(rows, columns=["n_words", "hits"])

    @F.pandas_udf("array<array<int>>")
    def merge(spans: pd.Series) -> pd.Series:
        return spans.map(lambda x: [list(s) for s in merge_spans([tuple(s) for s in x])] if x is not None else None)

    @F.pandas_udf("array<array<int>>")
    def in_bytes(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, listed in zip(text, spans, strict=True):
            words = _Words(t.encode("utf-8", "surrogatepass")) if listed is not None and len(listed) else None
            out.append([[int(words.start[a]), int(words.end[b - 1])] for a, b in listed] if words else [])
        return pd.Series(out, index=text.index, dtype=object)

    # rows are numbered before they are written, so that a number stays its row's
    rows = saved(docs.withColumns({"__row": F.monotonically_increasing_id(), "__maybe": maybe.asNondeterministic()(F.col(text_col))}), "scanned")
    hits = rows.select("__row", F.explode("__maybe.hits").alias("h")).select("__row", "h.*").join(windows, ["length", "hash", "words"])
    met = hits.groupBy("__row").agg(F.collect_set(F.array("at", F.col("at") + F.col("length"))).alias("__spans"), F.sort_array(F.collect_set("item")).alias("__items"))
    met = saved(met.withColumn("__spans", merge("__spans")).withColumnRenamed("__row", "__of"), "met")
    few = met.count() <= HIT_ROWS
    out = rows.join(F.broadcast(met) if few else met, F.col("__row") == F.col("__of"), "left")
    none = F.array().cast("array<array<int>>")
    spans = F.coalesce("__spans", none)
    found = F.struct(F.col("__maybe.n_words").alias("n_words"), spans.alias("spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"), F.when(F.size(spans) > 0, in_bytes(F.col(text_col), spans)).otherwise(none).alias("bytes"))
    return out.select(*docs.columns, found.alias(as_col))


def report(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated. Columns beyond id and text are not read."""
    rows = scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), benchmark, item_col=item_col, item_text_col=item_text_col, n=n)
    found = rows.select("id", "found.*")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s[1] - s[0]))
    return found.select(
        F.col("id").alias(id_col),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str | None, spans) -> str | None:
    """The text without the given byte spans; a newline stands for each."""
    if text is None or spans is None or not len(spans):
        return text
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"\n".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = WINDOW, remove: str = "documents", n_chars_col: str | None = None) -> DataFrame:
    """`docs` without benchmark windows, in the columns it came with.

    remove="documents": rows with any hit go. remove="spans": hit spans are cut out of the text (and `n_chars_col`, if named, is
    counted anew); a row left without a word goes. Rows without hits stay as they are, null and empty texts too. Other columns are
    carried whatever their names.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    plain, t, *count = masked(docs, text_col, *([n_chars_col] if n_chars_col else []))
    rows = scan(plain, benchmark, text_col=t, item_col=item_col, item_text_col=item_text_col, n=n, as_col="__found")
    hit = F.size("__found.spans") > 0
    if remove == "documents":
        return unmasked(rows.where(~hit), docs.columns)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(x, s) for x, s in zip(text, spans, strict=True)], index=text.index, dtype=object)

    rows = rows.withColumn(t, F.when(hit, cut(F.col(t), F.col("__found.bytes"))).otherwise(F.col(t)))
    rows = rows.where(~hit | F.coalesce(F.col(t).rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False)))
    for c in count:
        rows = rows.withColumn(c, F.when(hit, F.char_length(t).cast(plain.schema[c].dataType)).otherwise(F.col(c)))
    return unmasked(rows, docs.columns)
