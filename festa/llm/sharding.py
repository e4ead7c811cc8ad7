"""Sharding by size-tiered compaction over immutable files and versioned manifests.

Arrivals are appended as small immutable Parquet shards. Shards of similar size form tiers (each tier ``RATIO``
times the size of the one below); a tier that holds a run of at least ``FAN_IN`` shards is merged into files of
the target size, without a shuffle, and tiers are merged until none is full. Every change commits a new
manifest: the list of live shards is written to a file of its own and renamed to its version, which fails
if that version exists, so readers see the old list or the new one and of two writers one must retry. Files that
no kept version names are removed by ``vacuum``. Only file names and sizes pass the driver.

Defined results: rows keep all columns, nulls and repeats; an empty arrival commits a version without new
shards; an empty store reads as an empty table of the schema it was made with; columns may have any names.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from festa.llm.common import ensure_checkpoint_dir, text_of

TARGET_BYTES = 128 * 2**20
#: Shards of up to this size are the lowest tier.
BASE_BYTES = 2**20
RATIO = 4
FAN_IN = 4
#: Arrivals that the registered query deals the table into, and merges that run at once.
ARRIVALS = 4
MERGES_AT_ONCE = 4


class ConflictError(RuntimeError):
    """Another writer has committed this version; read again and retry."""


def tier_of(size: int) -> int:
    tier, limit = 0, BASE_BYTES
    while size > limit:
        tier, limit = tier + 1, limit * RATIO
    return tier


def runs(shards: list[dict], target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> list[list[dict]]:
    """Runs to merge: the shards of each full tier, smallest first, in runs of about the target size and ``fan_in`` shards at least."""
    tiers: dict[int, list[dict]] = defaultdict(list)
    for s in shards:
        if s["bytes"] < target / 2:
            tiers[tier_of(s["bytes"])].append(s)
    out = []
    for tier in sorted(tiers):
        run: list[dict] = []
        for s in sorted(tiers[tier], key=lambda s: (s["bytes"], s["path"])):
            run.append(s)
            if len(run) >= fan_in and sum(x["bytes"] for x in run) >= target:
                out.append(run)
                run = []
        if len(run) >= fan_in:
            out.append(run)
    return out


class ShardStore:
    """A table of immutable shards below ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))

    def _list(self, folder: str, suffix: str) -> list[tuple[str, int]]:
        where = self._path(folder)
        if not self._fs.exists(where):
            return []
        found, it = [], self._fs.listFiles(where, True)
        while it.hasNext():
            status = it.next()
            name = status.getPath().toString()
            if name.endswith(suffix):
                found.append((name, status.getLen()))
        return sorted(found)

    def version(self) -> int:
        names = [p.rsplit("/", 1)[-1] for p, _ in self._list(f"{self.path}/manifest", ".json")]
        return max((int(n[1:-5]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if not version:
            return []
        stream = self._fs.open(self._path(f"{self.path}/manifest/v{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["shards"]
        finally:
            stream.close()

    def commit(self, shards: list[dict], base: int) -> int:
        """Make ``shards`` the version after ``base``, or raise ConflictError."""
        staged, final = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}.staged"), self._path(f"{self.path}/manifest/v{base + 1:012d}.json")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps({"version": base + 1, "base": base, "shards": shards}).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        option = gateway.jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(option, 1)
        how[0] = option.NONE
        try:
            self._files.rename(staged, final, how)
        except Exception as e:
            self._fs.delete(staged, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"version {base + 1} exists") from e
            raise
        return base + 1

    def _written(self, folder: str) -> list[dict]:
        return [{"path": p, "bytes": n} for p, n in self._list(folder, ".parquet")]

    def append(self, rows: DataFrame) -> int:
        """Write the rows as new shards, one for each partition that has rows, and commit them."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        base = self.version()
        return self.commit([*self.manifest(base), *self._written(folder)], base)

    def append_arrivals(self, rows: DataFrame, arrival: Column) -> list[int]:
        """Write rows in one pass, dealt by ``arrival``, and commit each arrival as a version of its own."""
        folder, name = f"{self.path}/data/{uuid.uuid4().hex}", "__arrival"
        rows.withColumn(name, arrival).write.partitionBy(name).parquet(folder)
        versions = []
        by_arrival: dict[str, list[dict]] = defaultdict(list)
        for shard in self._written(folder):
            by_arrival[shard["path"].split(f"{name}=", 1)[1].split("/", 1)[0]].append(shard)
        for key in sorted(by_arrival):
            base = self.version()
            versions.append(self.commit([*self.manifest(base), *by_arrival[key]], base))
        return versions

    def _merge(self, run: list[dict], target: int) -> list[dict]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        files = max(1, round(sum(s["bytes"] for s in run) / target))
        self._frame([s["path"] for s in run]).coalesce(files).write.parquet(folder)
        return self._written(folder)

    def compact(self, target: int = TARGET_BYTES, fan_in: int = FAN_IN) -> int:
        """Merge full tiers until there is none; each round commits one version."""
        while True:
            base = self.version()
            shards = self.manifest(base)
            todo = runs(shards, target, fan_in)
            if not todo:
                return base
            with ThreadPoolExecutor(MERGES_AT_ONCE) as pool:
                merged = [s for part in pool.map(lambda run: self._merge(run, target), todo) for s in part]
            gone = {s["path"] for run in todo for s in run}
            self.commit([*(s for s in shards if s["path"] not in gone), *merged], base)

    def _frame(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        paths = [s["path"] for s in self.manifest(version)]
        return self._frame(paths) if paths else self.spark.createDataFrame([], self.schema)

    def vacuum(self, keep: int = 1) -> int:
        """Remove files that none of the last ``keep`` versions names; run it when no writer is at work."""
        last = self.version()
        live = {s["path"] for v in range(max(1, last - keep + 1), last + 1) for s in self.manifest(v)}
        dead = [p for p, _ in self._list(f"{self.path}/data", ".parquet") if p not in live]
        for p in dead:
            self._fs.delete(self._path(p), False)
        return len(dead)


def shard_documents(docs: DataFrame, arrivals: int = ARRIVALS, target: int = TARGET_BYTES, path: str | None = None) -> ShardStore:
    """A compacted store of the whole table, which comes in several arrivals."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    store = ShardStore(spark, path, docs.schema)
    store.append_arrivals(docs, F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)), F.lit(0)))
    store.compact(target)
    store.vacuum()
    return store


def read_back(store: ShardStore) -> DataFrame:
    """doc_id, lang, source, n_chars, text_sha256, read from the shards of the last version."""
    return store.read().select("doc_id", "lang", "source", F.char_length(text_of()).cast("bigint").alias("n_chars"), F.sha2(text_of().cast("binary"), 256).alias("text_sha256"))
