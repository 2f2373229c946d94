"""A table of session snapshots that a stream adds to exactly once, compacted while it is read.

Rows lie in folders; a manifest names the folders that count and the last batch of the stream. Manifests are
numbered, and a number is taken by creating its file, which only one writer can. So a reader sees a whole
state, a repeated batch finds its number in the manifest and changes nothing, and a compaction that
lost a race tries again on top of what came between.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "session_id string, version bigint, payload string"
ATTEMPTS = 20


class SnapshotTable:
    """Snapshots under a path that all executors and readers share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        at = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json"))

    def _state(self, number: int) -> dict | None:
        """A manifest, or null while it is being written."""
        with_stream = self._fs.open(self._path(f"{self.path}/manifests/{number:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
        finally:
            with_stream.close()
        return json.loads(text) if text.endswith("}") else None

    def state(self) -> tuple[int, dict]:
        """The newest whole manifest and its number."""
        for n in reversed(self._numbers()):
            found = self._state(n)
            if found is not None:
                return n, found
        return -1, {"folders": [], "batch": -1}

    def _commit(self, number: int, state: dict) -> bool:
        """Whether this writer took the number."""
        at = self._path(f"{self.path}/manifests/{number:012d}.json")
        try:
            out = self._fs.create(at, False)
        except Exception as why:
            if self._fs.exists(at):
                return False
            raise why
        out.write(json.dumps(state).encode())
        out.close()
        return True

    def _written(self, rows: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        newest = rows.groupBy("session_id").agg(F.max(F.struct("version", "payload")).alias("s"))
        newest.select("session_id", F.col("s.version").cast("bigint").alias("version"), "s.payload").write.parquet(f"{self.path}/rows/{folder}")
        return folder

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Adds a batch of snapshots (session_id, version, payload); false if it is there already."""
        folder = None
        for _ in range(ATTEMPTS):
            n, state = self.state()
            if batch <= state["batch"]:
                return False
            folder = folder or self._written(rows, f"batch{batch}")
            if self._commit(n + 1, {"folders": [*state["folders"], folder], "batch": batch}):
                return True
        raise RuntimeError(f"no manifest could be taken in {ATTEMPTS} attempts")

    def stream(self, rows: DataFrame, checkpoint: str):
        """A query over a stream of snapshots that adds each micro-batch; not started yet."""
        return rows.writeStream.foreachBatch(lambda batch, n: self.add(batch, n) and None).option("checkpointLocation", checkpoint)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/rows/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The newest version of each session; an older one that came later replaces none."""
        d = self._read(self.state()[1]["folders"]).groupBy("session_id").agg(F.max(F.struct("version", "payload")).alias("s"))
        return d.select("session_id", "s.version", "s.payload")

    def compact(self) -> bool:
        """Puts all folders into one; batches that come meanwhile stay beside it. False if there is nothing to do."""
        _, first = self.state()
        if len(first["folders"]) < 2:
            return False
        whole = self._written(self._read(first["folders"]), "whole")
        for _ in range(ATTEMPTS):
            n, state = self.state()
            if not set(first["folders"]) <= set(state["folders"]):
                return False  # another compaction took them
            later = [f for f in state["folders"] if f not in first["folders"]]
            if self._commit(n + 1, {"folders": [whole, *later], "batch": state["batch"]}):
                return True
        raise RuntimeError(f"no manifest could be taken in {ATTEMPTS} attempts")

    def clean(self, keep: int = 2) -> int:
        """Deletes folders that none of the newest manifests names, and older manifests; readers that began longer ago lose them."""
        numbers = self._numbers()
        held = {f for n in numbers[-keep:] for f in (self._state(n) or {"folders": []})["folders"]}
        at = self._path(f"{self.path}/rows")
        gone = [s.getPath() for s in self._fs.listStatus(at) if s.getPath().getName() not in held] if self._fs.exists(at) else []
        for folder in gone:
            self._fs.delete(folder, True)
        for n in numbers[:-keep]:
            self._fs.delete(self._path(f"{self.path}/manifests/{n:012d}.json"), False)
        return len(gone)
