"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is `spark.checkpoint.dir` where that is set; only where neither it nor the
    context's checkpoint folder is set (tests on one machine) a new one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return str(context.getCheckpointDir()).rstrip("/")


def new_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/gradeloom-{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs a reread, never a second run of what made the rows.
    """
    spark = df.sparkSession
    path = new_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def masked(docs: DataFrame, *names: str) -> tuple:
    """`docs` with its columns named c0, c1, ..., so that no name in it meets one of an operator's, and the new names of `names`.

    Columns are told apart by place: names with dots, in other case or twice are carried like any other.
    """
    columns = docs.columns
    folded = [c.lower() for c in columns]
    at = [columns.index(n) if n in columns else folded.index(n.lower()) for n in names]
    return docs.toDF(*[f"c{i}" for i in range(len(columns))]), *[f"c{i}" for i in at]


def unmasked(rows: DataFrame, columns: Sequence[str], *more: str) -> DataFrame:
    """The masked columns of `rows` under their own names again, and the columns `more`, which take the place of any of their names."""
    kept = [i for i, c in enumerate(columns) if c not in more]
    return rows.select(*[f"c{i}" for i in kept], *more).toDF(*[columns[i] for i in kept], *more)


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null ids give null."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def bounded_sample(rows: DataFrame, id_col: str, limit: int) -> DataFrame:
    """About `limit` rows at most, chosen by a hash of the id: the same rows on any cluster.

    Used only to fit classifiers on labelled rows.
    """
    total = rows.count()
    if total <= limit:
        return rows
    return rows.where(F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(17)), 1) < F.lit(sample_bound(total, limit)))


def sample_bound(total: int, limit: int) -> int:
    """The 63-bit hashes under it are `limit` of `total` rows, about."""
    return (limit << 63) // max(1, total) if total > limit else 1 << 63


def groups(texts: Sequence[str | None], limit: int = 2_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """Deal texts into groups of about `limit` characters; a longer text is cut behind a space where it has one.

    Yields positions and pieces; every character is in exactly one piece.
    """
    at: list[int] = []
    pieces: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        start, text = 0, text or ""
        while True:
            stop = len(text)
            if stop - start > limit:
                cut = text.rfind(" ", start, start + limit)
                stop = cut + 1 if cut > start else start + limit
            at.append(i)
            pieces.append(text[start:stop])
            held += stop - start
            start = stop
            if held >= limit:
                yield at, pieces
                at, pieces, held = [], [], 0
            if start >= len(text):
                break
    if at:
        yield at, pieces


def rows_in(batches: Iterable, rows: int = 1000, size: int = 16_000_000, text: str = "text") -> Iterator:
    """Cut pandas frames into frames of at most `rows` rows and about `size` characters."""
    for frame in batches:
        start, held = 0, 0
        for i, n in enumerate(frame[text].str.len().fillna(0)):
            if i > start and (i - start >= rows or held + n > size):
                yield frame.iloc[start:i]
                start, held = i, 0
            held += n
        if start < len(frame):
            yield frame.iloc[start:]


def batches_in(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 16_000_000, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into batches of at most `rows` rows and about `size` bytes of text, each a copy: string kernels of Arrow take
    slices whose offsets don't begin at 0 for other texts (`ascii_lower` after a cast)."""
    for batch in batches:
        upto = np.cumsum(pc.binary_length(batch[text]).fill_null(0).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(upto):
            full = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + size, side="right"))
            stop = max(start + 1, min(start + rows, full))
            yield batch.take(pa.array(np.arange(start, stop)))
            start = stop


#: Rows that hold a part's share of a sum of vectors, block by block.
BLOCKS = "vector int, block int, part long, kind string, at binary, x binary"
BLOCK = 1 << 15
#: Blocks that a task lays out at once.
BLOCKS_AT_ONCE = 16


def blocks(vector: int, x: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows of BLOCKS for a task's share `x` of a vector: blocks of zeros are left out, thin ones list what they hold."""
    out, part = [], TaskContext.get().partitionId()
    for i in range(0, len(x), BLOCK):
        piece = x[i : i + BLOCK]
        full = np.flatnonzero(piece)
        if len(full):
            thin = 2 * len(full) < len(piece)
            out.append((vector, i // BLOCK, part, piece.dtype.str, full.astype("<u4").tobytes() if thin else b"", (piece[full] if thin else piece).tobytes()))
        if len(out) == BLOCKS_AT_ONCE or out and i + BLOCK >= len(x):
            yield pd.DataFrame(out, columns=["vector", "block", "part", "kind", "at", "x"])
            out = []


def _add_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK)
    for kind, at, x in zip(frame["kind"], frame["at"], frame["x"], strict=True):
        x = np.frombuffer(x, kind)
        if len(at):
            total[np.frombuffer(at, "<u4")] += x
        else:
            total[: len(x)] += x
    first = frame.iloc[:1]
    return first.assign(kind=total.dtype.str, at=[b""], x=[total.tobytes()])


def tree_sum(rows: DataFrame, sizes: Sequence[int], fan: int = 64) -> list[np.ndarray]:
    """Sums, of the given sizes, of the vectors whose shares `rows` (BLOCKS) hold.

    Blocks are added by groups of `fan` partitions and then the groups' sums, so no task holds a block of every partition.
    The driver gets the sums alone.
    """
    near = rows.groupBy("vector", "block", F.floor(F.col("part") / fan)).applyInPandas(_add_blocks, BLOCKS)
    out = [np.zeros(-(-n // BLOCK) * BLOCK) for n in sizes]
    for row in near.groupBy("vector", "block").applyInPandas(_add_blocks, BLOCKS).select("vector", "block", "x").toLocalIterator():
        out[row["vector"]][row["block"] * BLOCK :][:BLOCK] = np.frombuffer(row["x"])
    return [x[:n] for x, n in zip(out, sizes, strict=True)]
