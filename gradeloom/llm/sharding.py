"""A table of immutable shards with size-tiered compaction and versioned manifests.

An append writes small Parquet shards as a run and commits a manifest that lists it. Compaction merges runs of similar size
into files of a target size. A manifest is a new numbered file, made visible by one rename that fails if the number is taken;
readers see the shards of one version, and shards are never changed.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_dir

TARGET_BYTES = 128 << 20
FANOUT = 4
BASE_BYTES = 1 << 20


class CommitConflict(RuntimeError):
    """Another writer took the version."""


@dataclass
class Run:
    name: str
    files: list[str]
    bytes: int
    rows: int
    tier: int


@dataclass
class Manifest:
    version: int = 0
    schema: str = ""
    runs: list[Run] = field(default_factory=list)


def tier_of(size: int, base: int = BASE_BYTES, fanout: int = FANOUT) -> int:
    """0 up to `base` bytes; one more for each factor of `fanout`."""
    return 0 if size <= base else 1 + int(math.log(size / base, fanout))


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, base_bytes: int = BASE_BYTES):
        self.spark, self.path = spark, path.rstrip("/")
        self.target, self.fanout, self.base = target_bytes, fanout, base_bytes
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs

    # files, through Hadoop's file system: the table may lie wherever Spark can write

    def _path(self, name: str = ""):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str):
        at = self._path(name)
        return list(self._fs().listStatus(at)) if self._fs().exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for s in self._list("manifests") if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A committed version, the newest by default; of a new table, version 0 without runs."""
        at = version if version is not None else (self.versions() or [0])[-1]
        if not at:
            return Manifest()
        stream = self._fs().open(self._path(f"manifests/v{at:012d}.json"))
        try:
            raw = json.loads(str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()
        return Manifest(raw["version"], raw["schema"], [Run(**r) for r in raw["runs"]])

    def _commit(self, manifest: Manifest) -> Manifest:
        """Make the manifest visible at once; CommitConflict if its version exists."""
        draft, final = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/v{manifest.version:012d}.json")
        stream = self._fs().create(draft, False)
        try:
            stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        try:
            none = self.spark.sparkContext._gateway.new_array(rename, 1)
            none[0] = rename.NONE
            context.rename(draft, final, none)
        except Exception as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"version {manifest.version} exists") from e
            raise
        return manifest

    def _runs(self, places: list[str]) -> list[Run]:
        """The runs that lie in the given folders, without those that have no row; all are counted in one job."""
        files = {p: sorted((f"{p}/{s.getPath().getName()}", int(s.getLen())) for s in self._list(p) if s.getPath().getName().startswith("part-")) for p in places}
        paths = [f"{self.path}/{f}" for listed in files.values() for f, _ in listed]
        if not paths:
            return []
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
        counts = self.spark.read.schema("__none int").parquet(*paths).groupBy(folder.alias("folder")).count().collect()  # a row per run
        rows = {unquote(r["folder"]): r["count"] for r in counts}
        sizes = {p: sum(n for _, n in listed) for p, listed in files.items()}
        return [Run(p, [f for f, _ in files[p]], sizes[p], rows[p.rsplit("/", 1)[-1]], tier_of(sizes[p], self.base, self.fanout)) for p in places if rows.get(p.rsplit("/", 1)[-1])]

    def append(self, rows: DataFrame, arrival: str | None = None) -> Manifest:
        """Write an arrival as a run and commit it. With `arrival`, a column, each of its values is an arrival and a commit of its own;
        all are written in one pass. Rows are stored as they are, nulls and repeats included; an arrival without rows commits nothing.
        Where another writer takes the version, the run is committed as the next one.
        """
        where = f"runs/{uuid.uuid4().hex}"
        now = self.manifest()
        kept = rows.drop(arrival) if arrival else rows
        schema = now.schema or kept.schema.json()
        if arrival:
            rows.write.partitionBy(arrival).parquet(f"{self.path}/{where}")
            places = sorted(f"{where}/{s.getPath().getName()}" for s in self._list(where) if s.isDirectory())
        else:
            rows.write.parquet(f"{self.path}/{where}")
            places = [where]
        for run in self._runs(places):
            now = self._rebased(now, lambda m, run=run: Manifest(m.version + 1, m.schema or schema, [*m.runs, run]))
        if not now.version:
            now = self._rebased(now, lambda m: Manifest(m.version + 1, m.schema or schema, m.runs))
        return now

    def _rebased(self, now: Manifest, change, tries: int = 20) -> Manifest:
        """Commit `change` of the newest version; the work is not lost to a writer that was faster."""
        for _ in range(tries):
            try:
                return self._commit(change(now))
            except CommitConflict:
                now = self.manifest()
        raise CommitConflict(f"no version could be had in {tries} tries")

    def compact(self) -> Manifest:
        """Merge tiers with `fanout` runs or more, until none has; the merged files are of about `target_bytes`."""
        now = self.manifest()
        while True:
            tiers: dict[int, list[Run]] = {}
            for run in now.runs:
                tiers.setdefault(run.tier, []).append(run)
            full = [t for t, runs in sorted(tiers.items()) if len(runs) >= self.fanout]
            if not full:
                return now
            merged = tiers[full[0]]
            size = sum(r.bytes for r in merged)
            where = f"runs/{uuid.uuid4().hex}"
            files = max(1, round(size / self.target))
            rows = self._open(now.schema, merged)
            # no shuffle: whole input splits are joined to files of the target size
            rows.coalesce(files).write.parquet(f"{self.path}/{where}")
            (run,) = self._runs([where])
            if run.rows != sum(r.rows for r in merged):
                raise RuntimeError("a merge lost rows; nothing was committed")
            run.tier = max(run.tier, full[0] + 1)
            gone = {r.name for r in merged}

            def merge(m: Manifest, run=run, gone=gone) -> Manifest:
                if not gone <= {r.name for r in m.runs}:
                    raise RuntimeError("another writer merged the same runs; nothing was committed")
                return Manifest(m.version + 1, m.schema, [*[r for r in m.runs if r.name not in gone], run])

            now = self._rebased(now, merge)

    def _open(self, schema: str, runs: list[Run]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        files = [f"{self.path}/{f}" for r in runs for f in r.files]
        return self.spark.read.schema(kind).parquet(*files) if files else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        now = self.manifest(version)
        if not now.version:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._open(now.schema, now.runs)

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete manifests but the newest `keep_versions`, and files that none of these lists; returns the number of files deleted.

        Files of an append or merge under way are deleted too: run it while nothing writes.
        """
        versions = self.versions()
        kept = {f for v in versions[-keep_versions:] for r in self.manifest(v).runs for f in r.files}
        for v in versions[:-keep_versions]:
            self._fs().delete(self._path(f"manifests/v{v:012d}.json"), False)
        gone = 0
        folders = [f"runs/{s.getPath().getName()}" for s in self._list("runs")]
        folders += [f"{f}/{s.getPath().getName()}" for f in folders for s in self._list(f) if s.isDirectory()]
        for folder in folders:
            for s in self._list(folder):
                name = f"{folder}/{s.getPath().getName()}"
                if s.isFile() and name not in kept and s.getPath().getName().startswith("part-"):
                    self._fs().delete(self._path(name), False)
                    gone += 1
        return gone


def arrivals_compacted(docs: DataFrame, *, id_col: str = "doc_id", arrivals: int = 16, **options) -> ShardTable:
    """Append `docs` as `arrivals` arrivals (dealt by a hash of the id), compact, and drop the shards that were merged.

    All columns are stored whatever their names (that of the arrival is chosen to be none of them); null ids are one arrival, repeated
    rows are stored each, and an empty table is a version without rows.
    """
    spark = docs.sparkSession
    table = ShardTable(spark, new_dir(spark, "shards"), **options)
    name, taken = "__arrival", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    dealt = docs.withColumn(name, F.pmod(F.xxhash64(F.col(id_col)), F.lit(arrivals)))
    table.append(dealt, name)
    table.compact()
    table.vacuum()
    return table
