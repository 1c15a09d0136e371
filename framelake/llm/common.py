"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that the driver and all executors share (spark.checkpoint.dir).

    A session in one process that leaves it unset (tests) gets a temporary one, removed when the process ends; on a cluster
    that is an error, as a machine's own folder would lose what other machines need.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="framelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Cuts the lineage at files which survive lost executors; Spark's commit
    protocol keeps one attempt of each task.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            jvm, sc = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext
            own = jvm.org.apache.hadoop.fs.Path(path)
            own.getFileSystem(sc._jsc.hadoopConfiguration()).delete(own, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs, which it finds when the driver's memory is collected."""
    spark.sparkContext._jvm.System.gc()


def folder_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files behind a staged table, for checks before a broadcast."""
    jvm = spark.sparkContext._jvm
    total = 0
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        total = fs.getContentSummary(path).getLength()
    return total


def let(value: Column, body) -> Column:
    """body(v) with v bound to value once.

    A column used inside a lambda would be evaluated again for every element if
    the optimizer merged its projection into the lambda; a bound one is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def open_shared(uri: str):
    """(pyarrow filesystem, path) of a URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def pieces(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most size bytes of text, of one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
