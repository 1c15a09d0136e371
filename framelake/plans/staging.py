"""Tables written once and read by several branches of a plan."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a new folder in the one that the driver and all executors share (spark.checkpoint.dir).

    A session in one process that leaves it unset gets a temporary one, removed when the process ends; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="framelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to a new shared folder and read again; cuts the lineage at files that survive lost executors."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df with all rows of a key in one of spark.sql.shuffle.partitions partitions.

    The rows are dealt by a hash of their own, of which no plan knows: Spark may leave out a repartition by columns that its input is dealt by
    already, and then, if that input is a union, coalesce the sides apart, so one key's rows end in two partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.withColumn("dealt_by", F.xxhash64(F.lit(17), *key)).repartition(n, "dealt_by").drop("dealt_by")


def runs_of(batches, key: str):
    """Tables of the rows of one key, out of batches in which they follow each other."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        names = held.column(key)
        cuts = [0, *(np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy()) + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield held.slice(a, b - a)
        held = held.slice(cuts[-1])
    if held is not None:
        yield held
