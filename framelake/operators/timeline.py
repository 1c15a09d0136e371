"""Decode and presentation times of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACK = ["archive_id", "track"]


def with_dts(samples: DataFrame) -> DataFrame:
    """dts: the sum of the deltas before each sample of its track (the first is 0); samples that have it are given back.  Overflow raises (ANSI sums)."""
    if "dts" in samples.columns:
        return samples
    before = Window.partitionBy(*TRACK).orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("dts", F.coalesce(F.sum("dts_delta").over(before), F.lit(0)).cast("long"))


def with_pts(samples: DataFrame) -> DataFrame:
    return with_dts(samples).withColumn("pts", F.col("dts") + F.col("cts_offset"))


def track_flags(samples: DataFrame) -> DataFrame:
    """Per track: rows, whether any composition offset is not 0, and whether all samples are sync (false for none)."""
    return samples.groupBy(*TRACK).agg(
        F.count(F.lit(1)).alias("n_samples"), F.bool_or(F.col("cts_offset") != 0).alias("has_ctts"), F.coalesce(F.every(F.col("is_sync")), F.lit(False)).alias("all_sync")
    )
