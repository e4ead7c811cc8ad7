"""Tables on disk that change: rows by key in buckets of immutable files, and a version pointer that moves atomically.

A change rewrites the buckets of the keys it names and leaves the files of all others alone (copy on write). Every
version is one small manifest, the files of each bucket; it is written aside and renamed to its number, which fails if
another writer was first, so that readers see one version or the next and writers never lose a change. A manifest may
carry notes, such as the last batch of a stream that it holds: a batch and its result are committed together.

Defined results: of several rows with one key in a change the greatest stays; a row without a key is left out; a key
that is both changed and deleted is changed; one that is both deleted and given values is deleted; a version that ``vacuum`` removed raises LookupError.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET, PART, KIND = "__bucket", "__part", "__kind"
#: What a row of a change is to its key.
OLD, GONE, SET, PUT = range(4)


class ConflictError(RuntimeError):
    """Another writer has committed a version since the one that this change was made from."""


class StoredTable:
    """A table below ``path`` (a folder that all executors share). ``buckets`` is fixed for the life of the table."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._hadoop, conf = hadoop, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = hadoop.Path(self.path).getFileSystem(conf)
        self._context = hadoop.FileContext.getFileContext(hadoop.Path(self.path).toUri(), conf)
        self._fs.mkdirs(hadoop.Path(f"{self.path}/versions"))

    # files

    def _file(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/versions"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0].isdigit())

    def version(self) -> int:
        """The last version; 0 before the first change."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "files": {}, "notes": {}}
        where = self._hadoop.Path(self._file(version))
        if not self._fs.exists(where):
            raise LookupError(f"version {version} is not kept")
        stream = self._fs.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, base: int, files: dict[str, list[str]], notes: dict) -> int:
        aside = self._hadoop.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": base + 1, "files": files, "notes": notes}).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        plain = gateway.new_array(self._hadoop.Options.Rename, 1)
        plain[0] = self._hadoop.Options.Rename.NONE
        try:
            self._context.rename(aside, self._hadoop.Path(self._file(base + 1)), plain)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise ConflictError(f"version {base + 1} is there") from e
            raise
        return base + 1

    # rows

    def _of_files(self, files: Iterable[str]) -> DataFrame:
        paths = sorted(files)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._of_files(p for files in self.manifest(version)["files"].values() for p in files)

    def note(self, name: str, version: int | None = None):
        return self.manifest(version)["notes"].get(name)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _merged(self, old: DataFrame, changes: DataFrame, values: dict[str, Column]) -> DataFrame:
        """The rows of ``old`` after ``changes`` (key, KIND, row), with BUCKET: old and new rows move once, to where they are written.

        A bucket is dealt into parts by key, so that no task grows with the table.
        """
        rest = [f.name for f in self.schema if f.name != self.key]
        rows = old.select(self.key, F.lit(OLD).alias(KIND), F.struct(*rest).alias("r")).unionByName(changes)
        parts = max(1, -(-4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets))
        by = [BUCKET, PART, self.key]
        rows = rows.withColumns({BUCKET: self._bucket(), PART: F.pmod(F.hash(self.key), F.lit(parts))}).repartition(BUCKET, PART)
        of = lambda kind: F.max(F.when(F.col(KIND) == kind, F.col("r")))
        told = rows.groupBy(*by).agg(of(OLD).alias("old"), of(PUT).alias("put"), F.bool_or(F.col(KIND) == GONE).alias("gone"), F.bool_or(F.col(KIND) == SET).alias("set"))
        told = told.withColumn("r", F.coalesce("put", F.when(~F.col("gone"), F.col("old")))).filter("r is not null")
        changed = F.col("set") & F.col("put").isNull()
        columns = [F.when(changed, values[c]).otherwise(F.col(f"r.{c}")).alias(c) if c in values else F.col(f"r.{c}") for c in rest]
        return told.select(self.key, *columns, BUCKET).select(*self.schema.names, BUCKET)

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(folder)
        found: dict[str, list[str]] = defaultdict(list)
        it = self._fs.listFiles(self._hadoop.Path(folder), True)
        while it.hasNext():
            name = it.next().getPath().toString()
            if name.endswith(".parquet") and f"{BUCKET}=" in name:
                found[name.rsplit(f"{BUCKET}=", 1)[1].split("/", 1)[0]].append(name)
        return found

    def change(self, rows: DataFrame | None = None, gone: DataFrame | None = None, notes: dict | None = None, base: int | None = None, keys: DataFrame | None = None, **values: Column) -> int:
        """Put ``rows`` (by key: they replace or add), remove the keys of ``gone``, give the known ones of ``keys`` these ``values``; the new version.

        With ``base``, the version that the change was made from, a later version raises ConflictError; without it the change is
        made again on what another writer has committed meanwhile.
        """
        own = lambda f: F.col(f.name).cast(f.dataType).alias(f.name)
        row = F.struct(*[own(f) for f in self.schema if f.name != self.key])
        values = {c: v.cast(self.schema[c].dataType) for c, v in values.items()}
        none = F.lit(None).cast(StructType([f for f in self.schema if f.name != self.key]))
        given = [(rows, PUT, row), (gone, GONE, none), (keys, SET, none)]
        made = [df.select(own(self.schema[self.key]), F.lit(kind).alias(KIND), r.alias("r")) for df, kind, r in given if df is not None]
        changes = reduce(DataFrame.unionByName, made).filter(F.col(self.key).isNotNull()) if made else None
        touched = {str(r[0]) for r in changes.select(self._bucket()).distinct().collect()} if made else set()  # at most the number of buckets
        while True:
            at = self.version() if base is None else base
            was = self.manifest(at)
            files = {b: f for b, f in was["files"].items() if b not in touched}
            if touched:
                old = self._of_files(p for b, f in was["files"].items() if b in touched for p in f)
                files |= self._write(self._merged(old, changes, values))
            try:
                return self._commit(at, files, was["notes"] | (notes or {}))
            except ConflictError:
                if base is not None:
                    raise

    def vacuum(self, keep: int = 2) -> int:
        """Remove versions but the last ``keep`` and the files that none of those names; run it when no writer is at work."""
        versions = self.versions()
        live = {p for v in versions[-keep:] for files in self.manifest(v)["files"].values() for p in files}
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop.Path(self._file(v)), False)
        gone, data = 0, self._hadoop.Path(f"{self.path}/data")
        it = self._fs.listFiles(data, True) if self._fs.exists(data) else None
        while it and it.hasNext():
            where = it.next().getPath()
            if where.getName().endswith(".parquet") and where.toString() not in live:
                gone += self._fs.delete(where, False)
        return gone
