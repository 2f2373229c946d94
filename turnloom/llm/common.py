"""What the operators of this folder share: code shipping, shared storage, Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from turnloom.ship import ship

#: Rows of an Arrow batch sent to Python; long texts make batches of any row count large, so
#: the byte bound below holds as well.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Ship this package to the executors once per application and bound Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Where the setting is absent, a fresh temporary folder serves in local mode, as in tests; on a
    cluster that would be another folder on each machine, so there the absence is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = getattr(sc, "_turnloom_shared", None)
        if named is None:
            named = sc._turnloom_shared = "file://" + tempfile.mkdtemp(prefix="shared")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage, survives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: compressed, for tables with texts."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    released(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again, once all made from them is written."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Spark deletes a finished query's shuffle files when the driver collects what refers to them, which can be long after: collect now."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def shared_bytes(spark: SparkSession, path: str, limit: int = 64 << 20):
    """A vocabulary file as a broadcast variable; its size is checked against limit."""
    n = os.path.getsize(path)
    if n > limit:
        raise ValueError(f"{path} has {n} bytes; at most {limit} are broadcast")
    held = spark.sparkContext.__dict__.setdefault("_turnloom_files", {})
    if path not in held:
        held[path] = spark.sparkContext.broadcast(Path(path).read_bytes())
    return held[path]


def chunks_by_size(texts: list[str], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of at most limit characters together (or one text)."""
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and size + len(t) > limit:
            yield a, i
            a, size = i, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)


def map_texts(df: DataFrame, text: str, keep: list[str], fn: Callable[..., dict[str, pa.Array]], schema: str, also: str | None = None) -> DataFrame:
    """Run fn over bounded lists of whole texts in Arrow batches.

    keep: columns carried unchanged. fn gets the texts (null becomes empty), with also that
    column's values as a second list, and gives columns of equal length. schema: DDL of fn's columns only. Extra columns of df are dropped, so no
    name of theirs can clash.
    """

    prepare(df.sparkSession)
    src = df.select(*[df[c] for c in keep], df[text].alias("__text"), *([df[also].alias("__also")] if also else []))
    names = list(keep)
    out_schema = ", ".join([f"`{c}` {dict(src.dtypes)[c]}" for c in names] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("__text").to_pylist()]
            more = [b.column("__also").to_pylist()] if also else []
            for lo, hi in chunks_by_size(texts):
                cols = {c: b.column(c).slice(lo, hi - lo) for c in names}
                cols |= fn(texts[lo:hi], *(m[lo:hi] for m in more))
                yield pa.RecordBatch.from_pydict(cols)

    return src.mapInArrow(run, out_schema)
