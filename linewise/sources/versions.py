"""Versions of a table in a folder: each is written whole beside the others, then named by a manifest; readers follow the last manifest.

A manifest has a number and is put in its place by one rename that fails where another was there first, so of two writers one has to try again, and a write that
breaks off leaves the last version as it was. The first version is never deleted; going back is one more version that names old rows. All stores that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made this version."""


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._hadoop.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self._conf), path

    def numbers(self) -> list[int]:
        fs, path = self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{number:09d}.json", wholetext=True).first().value)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        known = self.numbers()
        if not known or (number is not None and number not in known):
            raise ValueError(f"no version {number if number is not None else ''} in {self.folder}")
        found = self.manifest(known[-1] if number is None else number)
        return self.spark.read.schema(found["schema"]).parquet(f"{self.folder}/{found['rows']}")

    def write(self, rows: DataFrame, note: str = "", after: int | None = None) -> int:
        """A new version of these rows; its number. With `after` only if that is still the last version."""
        last = (self.numbers() or [0])[-1] if after is None else after
        place = f"rows/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{place}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        return self._put(last + 1, {"rows": place, "schema": schema, "note": note, "from": last})

    def back_to(self, number: int, note: str = "") -> int:
        """A new version with the rows of an old one."""
        known, old = self.numbers(), self.manifest(number)
        return self._put(known[-1] + 1, old | {"note": note or f"back to {number}", "from": known[-1]})

    def changed(self, number: int, since: int, key: str = "work") -> DataFrame:
        """The rows of a version that are not those of another, by key: new and changed ones."""
        mark = lambda v: self.read(v).select(key, F.xxhash64(*[F.col(f"`{c}`") for c in self.read(v).columns]).alias("__mark"))
        return self.read(number).join(mark(number).join(mark(since), [key, "__mark"], "left_anti").select(key), key, "left_semi")

    def forget(self, keep: int = 5) -> int:
        """Delete the rows of all but the first and the last `keep` versions, unless one of these has them; returns how many."""
        known = self.numbers()
        kept = {known[0], *known[-keep:]} if known else set()
        alive = {self.manifest(n)["rows"] for n in kept}
        gone = {self.manifest(n)["rows"] for n in known if n not in kept} - alive
        for n in known:
            if n not in kept:
                fs, path = self._path(f"manifests/{n:09d}.json")
                fs.delete(path, False)
        for place in gone:
            fs, path = self._path(place)
            fs.delete(path, True)
        return len(gone)

    def _put(self, number: int, manifest: dict) -> int:
        fs, draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=True), "ascii"))
        out.close()
        _, path = self._path(f"manifests/{number:09d}.json")
        context = self._hadoop.FileContext.getFileContext(path.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(path), options)
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {number} of {self.folder} is there already") from error
            raise
        return number
