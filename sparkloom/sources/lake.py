"""A versioned table of Parquet files: a manifest per version, time travel, branches, restore, clone and vacuum.

A version is a JSON manifest that lists whole data folders, written under the next number; the writer that finds its
number taken has lost a race and raises. Manifests go through Spark's own file system layer, so any store works that
Spark can reach.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Lake:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _write(self, name: str, body: dict, fresh: bool = True) -> None:
        out = self._fs.create(self._p(name), not fresh)
        try:
            out.write(json.dumps(body).encode())
        finally:
            out.close()

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._p(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def versions(self, branch: str = "main") -> list[int]:
        folder = self._p(f"_manifest/{branch}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder))

    def _manifest(self, branch: str, version: int | None) -> dict:
        have = self.versions(branch)
        if not have:
            return {"folders": [], "at": 0.0, "op": "none"}
        return self._read(f"_manifest/{branch}/{have[-1] if version is None else version:09d}.json")

    def _commit(self, folders: list[str], op: str, branch: str, start: dict | None = None) -> int:
        have = self.versions(branch)
        number = have[-1] + 1 if have else 0
        start = start or (self._manifest(branch, None).get("start") if have else None)
        self._write(f"_manifest/{branch}/{number:09d}.json", {"folders": folders, "at": time.time(), "op": op} | ({"start": start} if start else {}))
        return number

    def _rewrite(self, condition, change, op: str, branch: str) -> int:
        """A version in which the folders that hold a hit are written anew by ``change``; the others stay as they are."""
        folders = self._manifest(branch, None)["folders"]
        found = self.read(branch=branch).filter(condition).select(F.regexp_extract("_metadata.file_path", r"/(data/[0-9a-f]{32})/", 1).alias("f")).distinct()
        hit = {r.f for r in found.collect()}  # at most the folders of one manifest
        if not hit:
            return self._commit(folders, op, branch)
        fresh = self._data(change(self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders if f in hit])))
        return self._commit([f for f in folders if f not in hit] + [fresh], op, branch)

    def _data(self, df: DataFrame) -> str:
        name = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def append(self, df: DataFrame, branch: str = "main") -> int:
        return self._commit([*self._manifest(branch, None)["folders"], self._data(df)], "append", branch)

    def overwrite(self, df: DataFrame, branch: str = "main", op: str = "overwrite") -> int:
        return self._commit([self._data(df)], op, branch)

    def read(self, version: int | None = None, at: float | None = None, branch: str = "main") -> DataFrame:
        """The newest version, or one by number, or the one that was newest at a time."""
        if at is not None:
            older = [v for v in self.versions(branch) if self._manifest(branch, v)["at"] <= at]
            if not older:
                raise ValueError("no version is that old")
            version = older[-1]
        folders = self._manifest(branch, version)["folders"]
        if not folders:
            raise ValueError("the table has no data")
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def delete_where(self, condition, branch: str = "main") -> int:
        return self._rewrite(condition, lambda df: df.filter(~F.coalesce(condition, F.lit(False))), "delete", branch)

    def update_where(self, condition, assignments: dict, branch: str = "main") -> int:
        change = lambda df: df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in assignments.items()})
        return self._rewrite(condition, change, "update", branch)

    def restore(self, version: int, branch: str = "main") -> int:
        return self._commit(self._manifest(branch, version)["folders"], "restore", branch)

    def create_branch(self, name: str, base: str = "main") -> int:
        folders = self._manifest(base, None)["folders"]
        return self._commit(folders, f"branch of {base}", name, {"base": base, "folders": folders})

    def fast_forward(self, base: str, branch: str) -> int:
        """Takes over the branch's newest version; raises if ``base`` holds other data than when the branch was made."""
        newest = self._manifest(branch, None)
        start = newest.get("start") or {}
        if start.get("base") != base or start["folders"] != self._manifest(base, None)["folders"]:
            raise RuntimeError(f"{base} is not what {branch} was made from")
        number = self._commit(newest["folders"], f"merge of {branch}", base)
        self._commit(newest["folders"], f"merged into {base}", branch, {"base": base, "folders": newest["folders"]})
        return number

    def optimize(self, files: int, branch: str = "main") -> int:
        """Fewer, larger files; the version before stays readable."""
        return self.overwrite(self.read(branch=branch).repartition(files), branch, "optimize")

    def vacuum(self, keep: int = 1, branch: str = "main") -> list[str]:
        """Drops manifests but the newest so many of the branch, and data folders that no manifest of any branch names."""
        for v in self.versions(branch)[:-keep]:
            self._fs.delete(self._p(f"_manifest/{branch}/{v:09d}.json"), False)
        used = {f for s in self._fs.listStatus(self._p("_manifest")) for b in [s.getPath().getName()] for v in self.versions(b) for f in self._manifest(b, v)["folders"]}
        gone = [n for s in self._fs.listStatus(self._p("data")) if (n := f"data/{s.getPath().getName()}") not in used]
        for n in gone:
            self._fs.delete(self._p(n), True)
        return gone

    def history(self, branch: str = "main") -> DataFrame:
        rows = [(v, m["op"], m["at"], len(m["folders"])) for v in self.versions(branch) for m in [self._manifest(branch, v)]]
        return self.spark.createDataFrame(rows, "version int, op string, at double, folders int")
