"""A keyed table in hash buckets, changed by copy-on-write of the buckets that a delta touches.

Rows live in data/<folder>/_bucket=<n>, and a version is a manifest: one small file that names the folder of every bucket.
A write first puts the touched buckets' new rows into a folder of its own and then creates the next manifest, which can succeed only once
per number: readers see the version before or after, never a part, a lost writer leaves files that nobody names, and of two
writers of one version one fails. Buckets that no row of the delta falls into keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer has made this version."""


class BucketTable:
    """A table at `path`, keyed by the columns `key`, in `buckets` buckets (fixed when it is first written).

    A bucket is rewritten by one task, so there should be as many as keep one within a few hundred MB.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        files, at = self._files(), self._path(folder)
        return [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifest") if n.endswith(".json") and n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """Version, number of buckets, schema, and folder by bucket; the last version's if none is named; None if there is none."""
        known = self.versions()
        number = version if version is not None else known[-1] if known else -1
        if number not in known:
            return None
        stream = self._files().open(self._path("manifest", f"{number}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _swap(self, manifest: dict) -> None:
        """Writes a manifest aside and renames it to its number, which fails where that exists."""
        files, aside = self._files(), self._path("manifest", f"_{uuid.uuid4().hex}")
        goal = self._path("manifest", f"{manifest['version']}.json")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if files.exists(goal) or not files.rename(aside, goal):
            files.delete(aside, False)
            raise Conflict(f"version {manifest['version']} of {self.path} exists")

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _of(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/data/{folder}/{BUCKET}={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the last one's if none is named; None before the first."""
        manifest = self.manifest(version)
        return None if manifest is None else self._of(manifest)

    def apply(self, delta: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], version: int | None = None) -> bool:
        """Changes the table to change(rows of the touched buckets, delta); the first delta is taken as it is.

        `version` is the number that this change has, by default the next one. If it exists nothing is done, so that
        a batch may be sent again; False then. The rows of the delta need keys without nulls, and `change` keeps the columns.
        """
        last = self.manifest()
        number = version if version is not None else last["version"] + 1 if last else 0
        if last and number <= last["version"]:
            return False
        buckets, folder = last["buckets"] if last else self.buckets, uuid.uuid4().hex
        landed = f"{self.path}/delta/{folder}"
        delta.write.parquet(landed)  # read twice below, and a stream's batch may be costly
        delta = self.spark.read.parquet(landed)
        touched = sorted(r[0] for r in delta.select(self.bucket(buckets)).distinct().collect())  # as many as there are buckets
        rows = delta if last is None else change(self._of(last, touched), delta)
        schema = json.loads(rows.schema.json()) if last is None else last["schema"]
        rows = rows.select(*[f["name"] for f in schema["fields"]]).withColumn(BUCKET, self.bucket(buckets))
        if touched:
            rows.repartition(len(touched), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{folder}")
        folders = (last["folders"] if last else {}) | {str(b): folder for b in touched}
        left = {n.removeprefix(f"{BUCKET}=") for n in self._names(f"data/{folder}")}
        folders = {b: f for b, f in folders.items() if f != folder or b in left}  # a change may leave a bucket empty
        self._swap({"version": number, "buckets": buckets, "schema": schema, "folders": folders})
        self._files().delete(self._path("delta", folder), True)
        return True

    def expire(self, keep: int = 2) -> int:
        """Forgets all but the last `keep` versions and deletes the buckets that no kept one names. Returns how many were deleted.

        Writes that are under way must have ended: their folders aren't named yet."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-keep:]]
        named = {(f, b) for m in kept for b, f in m["folders"].items()}
        files, gone = self._files(), 0
        for v in known[:-keep]:
            files.delete(self._path("manifest", f"{v}.json"), False)
        for folder in self._names("data"):
            own = [n.removeprefix(f"{BUCKET}=") for n in self._names(f"data/{folder}") if n.startswith(BUCKET)]
            dead = [b for b in own if (folder, b) not in named]
            for b in dead if len(dead) < len(own) else []:
                files.delete(self._path("data", folder, f"{BUCKET}={b}"), True)
            if len(dead) == len(own):
                files.delete(self._path("data", folder), True)
            gone += len(dead)
        return gone
