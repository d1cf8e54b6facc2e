"""Stored tables with keyed writes that leave untouched data alone.

Rows lie in buckets of their key's hash, each bucket in one or more folders. A manifest per version names the folders of
every bucket; it is the table's only pointer. A write reads the buckets that hold touched keys, writes new folders for
them, and then adds the next manifest: readers see the old version or the new one, a writer that fails before leaves
nothing but unreferenced folders, and of two writers of one version the second gets an error. Folders are never changed.

The manifest grows with the number of buckets, not with the rows; the driver reads nothing else.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressgrain.operators import tables

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has added the version that this write was to become."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifest

    def version(self) -> int:
        """The newest version; -1 if there is no table."""
        folder = self._file(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            raise FileNotFoundError(f"no table in {self.path}")
        rows = self.spark.read.text(f"{self.path}/manifest/{version:09d}.json", wholetext=True).collect()
        return json.loads(rows[0][0])

    def _commit(self, version: int, keys: Sequence[str], buckets: int, schema: StructType, folders: dict[str, list[str]]) -> None:
        text = json.dumps({"keys": list(keys), "buckets": buckets, "schema": schema.jsonValue(), "folders": folders})
        draft, final = self._file(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._file(f"{self.path}/manifest/{version:09d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    # Reading

    def _read(self, manifest: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        chosen = manifest["folders"] if buckets is None else {b: manifest["folders"][b] for b in buckets if b in manifest["folders"]}
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folders in chosen.items() for folder in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version))

    # Writing

    @staticmethod
    def _bucket(keys: Sequence[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: Sequence[str], buckets: int) -> tuple[str, list[str]]:
        """Write rows to a new folder; its name and the buckets in it."""
        name = uuid.uuid4().hex[:16]
        path = f"{self.path}/data/{name}"
        placed = rows.withColumn(BUCKET, self._bucket(keys, buckets))
        placed.repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(path)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._file(path))]
        return name, [n.split("=")[1] for n in found if n.startswith(f"{BUCKET}=")]

    def create(self, rows: DataFrame, keys: Sequence[str], buckets: int = 64) -> KeyedTable:
        """Store `rows`, one per key, as the first version. Keys must not be null."""
        name, filled = self._write(rows, keys, buckets)
        self._commit(0, keys, buckets, rows.schema, {b: [name] for b in filled})
        return self

    def _touched(self, changes: DataFrame, manifest: dict) -> list[str]:
        held = changes.select(self._bucket(manifest["keys"], manifest["buckets"]).alias("b")).distinct()
        return [str(r["b"]) for r in held.collect()]  # at most as many rows as buckets

    def _rewrite(self, before: int, manifest: dict, buckets: Sequence[str], rows: DataFrame) -> list[str]:
        """The next version, in which `rows` are the content of `buckets`; the buckets rewritten."""
        if not buckets:
            return []
        name, filled = self._write(rows, manifest["keys"], manifest["buckets"])
        folders = {b: f for b, f in manifest["folders"].items() if b not in set(buckets)} | {b: [name] for b in filled}
        self._commit(before + 1, manifest["keys"], manifest["buckets"], StructType.fromJson(manifest["schema"]), folders)
        return sorted(buckets, key=int)

    def _now(self) -> tuple[int, dict]:
        before = self.version()
        return before, self.manifest(before)

    def upsert(self, source: DataFrame) -> list[str]:
        """Put the source's rows in place of those of the same key, or add them; it holds one row per key. Returns the
        buckets that were rewritten, as all writes do."""
        before, manifest = self._now()
        touched = self._touched(source, manifest)
        return self._rewrite(before, manifest, touched, tables.upsert(self._read(manifest, touched), source, manifest["keys"]))

    def insert_ignore(self, source: DataFrame) -> list[str]:
        """Add the source's rows of new keys, in folders next to those that are there; no bucket is rewritten."""
        before, manifest = self._now()
        own = self._read(manifest, self._touched(source, manifest))
        fresh = source.select(*own.columns).join(own.select(*manifest["keys"]), manifest["keys"], "left_anti")
        name, filled = self._write(fresh, manifest["keys"], manifest["buckets"])
        if filled:
            folders = manifest["folders"] | {b: [*manifest["folders"].get(b, []), name] for b in filled}
            self._commit(before + 1, manifest["keys"], manifest["buckets"], StructType.fromJson(manifest["schema"]), folders)
        return sorted(filled, key=int)

    def _held(self, source: DataFrame, manifest: dict) -> list[str]:
        """Buckets in which keys of the source really are."""
        keys = manifest["keys"]
        own = self._read(manifest, self._touched(source, manifest)).select(*keys)
        return self._touched(own.join(source.select(*keys), keys, "left_semi"), manifest)

    def update_from(self, source: DataFrame, cols: Sequence[str]) -> list[str]:
        """Set the named columns to the source's non-null values where keys agree; it holds one row per key."""
        before, manifest = self._now()
        held = self._held(source, manifest)
        return self._rewrite(before, manifest, held, tables.update_from(self._read(manifest, held), source, manifest["keys"], list(cols)))

    def delete_using(self, source: DataFrame) -> list[str]:
        """Delete the rows whose keys the source has."""
        before, manifest = self._now()
        held = self._held(source, manifest)
        return self._rewrite(before, manifest, held, tables.delete_using(self._read(manifest, held), source, manifest["keys"]))

    def unreferenced(self, keep: int = 1) -> list[str]:
        """Data folders that none of the newest `keep` versions names: left by failed writers or older versions."""
        newest = self.version()
        used = {f for v in range(max(0, newest - keep + 1), newest + 1) for folders in self.manifest(v)["folders"].values() for f in folders}
        data = self._file(f"{self.path}/data")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(data) if s.getPath().getName() not in used)
