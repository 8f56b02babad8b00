"""Best-fit packing of token sequences into fixed-size training sequences.

Documents are tokenized and cut; short pieces are dealt evenly to packers, in hashed order. A packer keeps a bounded number of open
bins, found through a bitset keyed by free space: a piece goes to the fullest bin that still holds it, and when a bin must
close to make room, it is the fullest. Pieces come in rounds, the longest of a round first, so that short ones meet bins that lack
little; bins stay open from round to round.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import rows_in, saved

LENGTH = 2048
#: Open bins of a packer, at least as many as the pieces of a round, which may all be over half a sequence.
OPEN_BINS, ROUND = 4096, 4000
#: Pieces that one packer gets, about.
PACKER_ROWS = 100_000
CACHE = 400_000

_ODD = re.compile(r"\s\s|\x01")
_PLAIN = re.compile(r"(?<=\S) (?=\S)")


class CachedTokenizer:
    """Ids of texts as little-endian 32-bit bytes, with the ids of recent words kept.

    A text is cut before blanks and around line ends that stand between visible characters. The tokenizer's pattern never
    matches across such a place and looks no further than it, so the parts' ids are the text's ids. With `ranks`, the
    same vocabulary as ranks, new parts go to a faster encoder of it; those that hold a special token go to the tokenizer.
    """

    def __init__(self, path: str, ranks: str | None = None, cache: int = CACHE):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.fast = None
        if ranks:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def learn(self, part: str) -> bytes:
        if self.fast and not self.special.search(part):
            if part[-1:] in ".,;:!?" and part[-2:-1].isalpha():  # a sign behind a letter is a match of its own
                return self.get(part[:-1]) + self.get(part[-1])
            ids = self.fast(part)
        else:
            ids = self.tokenizer.encode(part, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def get(self, part: str) -> bytes:
        got = self.known.get(part)
        if got is None:
            got = self.known[part] = self.learn(part)
        return got

    def parts(self, text: str) -> list[str]:
        if _ODD.search(text):  # runs of white space: cut only between visible characters
            first, *rest = _PLAIN.split(text)
            return [first, *(" " + x for x in rest)]
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.cache:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            parts = self.parts(text)
            got = list(map(known.get, parts))
            if None in got:
                got = [self.get(p) if g is None else g for p, g in zip(parts, got, strict=True)]
            out.append(b"".join(got))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks: str | None) -> CachedTokenizer:
    return CachedTokenizer(path, ranks)


PIECES = "id string, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, ranks_path: str | None = None, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """Cut every row's ids and a closing `end_id` into pieces of `length`; the first piece takes what is over. Null text: empty."""
    path, ranks = tokenizer_path, ranks_path
    if path is None:
        path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(frames):
        coder = tokenizer(path, ranks)
        for frame in rows_in(frames, size=2_000_000):
            out = []
            for key, ids in zip(frame["id"], coder.encode([t or "" for t in frame["text"]]), strict=True):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % length + 1 if k == 0 else length
                    out.append((key, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            yield pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(cut, PIECES)


class OpenBins:
    """At most `most` open bins; bit f of `free` is set if some open bin has f places free."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.free, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, size: int) -> tuple[int, int]:
        """Bin and place for a piece of `size`."""
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1  # the least free space that is enough
            which = self.by_free[free].pop()
            if not self.by_free[free]:
                self.free &= ~(1 << free)
        else:
            if self.open >= self.most:
                self.close_fullest()
            free, which = self.length, self.made
            self.made += 1
            self.open += 1
        left = free - size
        if left:
            self.by_free[left].append(which)
            self.free |= 1 << left
        else:
            self.open -= 1
        return which, self.length - free

    def close_fullest(self) -> None:
        free = (self.free & -self.free).bit_length() - 1
        self.by_free[free].pop()
        if not self.by_free[free]:
            self.free &= ~(1 << free)
        self.open -= 1


def rounds(frames, size: int):
    """The rows of `frames`, `size` at a time (the last time fewer), the longest first."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        while sum(map(len, held)) >= size:
            whole = pd.concat(held)
            yield whole.iloc[:size].sort_values("length", ascending=False, kind="stable")
            held = [whole.iloc[size:]]
    if sum(map(len, held)):
        yield pd.concat(held).sort_values("length", ascending=False, kind="stable")


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    ranks_path: str | None = None,
    end_id: int = 0,
    length: int = LENGTH,
    open_bins: int = OPEN_BINS,
    packer_rows: int = PACKER_ROWS,
) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A full piece is a sequence of its own. The others are dealt in turn to packers of about `packer_rows`, equal rows too. Null and empty
    texts have the end id alone; null ids stay null; repeated rows are packed each, pieces of equal length in any order; other columns
    are not read; no rows, no pieces.
    """
    cut = saved(pieces(docs, id_col=id_col, text_col=text_col, tokenizer_path=tokenizer_path, ranks_path=ranks_path, end_id=end_id, length=length), "pieces")
    short = cut.where(F.col("length") < length)
    packers = max(1, -(-short.count() // packer_rows))
    full = cut.where(F.col("length") == length)

    def number(frames):  # full pieces: negative ids, by task and row
        at = -1 - (TaskContext.get().partitionId() << 40)
        for frame in frames:
            yield frame.assign(sequence_id=np.arange(at, at - len(frame), -1), offset=0)
            at -= len(frame)

    def fit(frames):
        bins, base = OpenBins(length, open_bins), TaskContext.get().partitionId() << 40
        for frame in rounds(frames, ROUND):
            put = [bins.put(int(n)) for n in frame["length"]]
            yield frame.assign(sequence_id=[base + which for which, _ in put], offset=[at for _, at in put])

    schema = PIECES + ", sequence_id long, offset long"
    # in turn: a group of equal rows spreads too; sorted, so that a rerun task sees the same rows in the same order
    dealt = short.repartition(packers).sortWithinPartitions(F.xxhash64("id", "piece", "length", "ids_crc32"), "id", "piece", "length", "ids_crc32")
    packed = dealt.mapInPandas(fit, schema).unionByName(full.mapInPandas(number, schema))
    return packed.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
