"""Stored tables that grow and empty by switching a manifest.

Rows lie in Parquet folders that are written once and never changed. A manifest names the
schema and the folders of a version; the newest manifest is the table. A writer first writes
its folder and then puts the next manifest in place with a rename that fails if that version is
already there. A write that breaks off, or a lost writer, leaves the table as it was; a reader
sees one version or the next. Works on every file system that Hadoop renames atomically on.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class ConflictError(RuntimeError):
    """Another writer has put the same version in place."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    # -- manifests

    def version(self) -> int:
        """Number of the newest manifest, 0 without any."""
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"schema": None, "folders": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _switch(self, base: int, manifest: dict) -> int:
        """Put ``manifest`` in place as the version after ``base``."""
        jvm = self.spark._jvm
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}")
        target = self._path(f"{self.root}/manifests/{base + 1:020d}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
                raise ConflictError(f"{self.root}: version {base + 1} is there already") from e
            raise
        return base + 1

    # -- the table

    def schema(self) -> T.StructType | None:
        known = self.manifest()["schema"]
        return T.StructType.fromJson(known) if known else None

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; columns that a folder lacks are null in its rows."""
        found = self.manifest(version)
        if found["schema"] is None:
            raise ValueError(f"{self.root}: no table")
        schema = T.StructType.fromJson(found["schema"])
        if not found["folders"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in found["folders"]])

    def append(self, rows: DataFrame) -> int:
        """Add rows as files of their own; columns the table lacks are added behind its own.

        A column of another type is an error before anything is written.
        """
        base = self.version()
        found = self.manifest(base)
        old = T.StructType.fromJson(found["schema"]) if found["schema"] else T.StructType()
        kinds = {f.name: f.dataType for f in old}
        for f in rows.schema:
            if f.name in kinds and kinds[f.name] != f.dataType:
                raise ValueError(f"{f.name} is {kinds[f.name].simpleString()}, not {f.dataType.simpleString()}")
        wider = T.StructType([*old.fields, *[T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in kinds]])
        folder = f"rows/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self._switch(base, {"schema": json.loads(wider.json()), "folders": [*found["folders"], folder]})

    def truncate(self) -> int:
        """A version without rows; the schema stays, and older versions can be read until ``clean``."""
        base = self.version()
        return self._switch(base, {"schema": self.manifest(base)["schema"], "folders": []})

    def clean(self) -> int:
        """Delete folders that the newest version does not name, and older manifests; returns how many folders went.

        Not to be run beside a writer: a folder that is written but not yet named would go too.
        """
        newest = self.version()
        used = {f.split("/")[-1] for f in self.manifest(newest)["folders"]}
        gone, folder = 0, self._path(f"{self.root}/rows")
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in used:
                self._fs.delete(s.getPath(), True)
                gone += 1
        for v in range(1, newest):
            self._fs.delete(self._path(f"{self.root}/manifests/{v:020d}.json"), False)
        return gone
