"""Keyframe-aligned segments across a video and an audio track.

All steps are keyed by archive_id; an archive's sample table is some 13 MB for two hours, so one archive is one
task's work and archives spread over the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import nominal_ticks, scale_ceil
from ..schema import U32_MAX
from .timeline import with_dts

def by_archive():
    return Window.partitionBy("archive_id")


def sync_cuts(video: DataFrame, seconds: float, method: str = "fold") -> DataFrame:
    """(archive_id, segment_idx, video_sample_start, video_base_dts): a cut at the first sync sample at least the nominal
    duration after the last cut.

    video: archive_id, sample_idx, dts, is_sync, timescale.  The base moves with every cut, which no window frame
    expresses: method ``fold`` folds the archive's ordered sync samples in one expression; ``arrow`` finds each cut by
    binary search in an Arrow group, for archives with more than some 100,000 sync samples.
    """
    points = video.filter(F.col("is_sync") | (F.col("sample_idx") == 0)).select("archive_id", "sample_idx", "dts", nominal_ticks(seconds, F.col("timescale")).alias("nominal"))
    if method == "arrow":
        return points.groupBy("archive_id").applyInArrow(_arrow_cuts, points.select("archive_id", F.lit(0).cast("long").alias("segment_idx"), F.col("sample_idx").alias("video_sample_start"), F.col("dts").alias("video_base_dts")).schema)
    cut = F.struct("sample_idx", "dts")
    groups = points.groupBy("archive_id").agg(F.array_sort(F.collect_list(cut)).alias("p"), F.max("nominal").alias("nominal"))
    empty = F.array().cast("array<struct<sample_idx:bigint,dts:bigint>>")
    far = lambda s, x: (F.size(s) == 0) | (x["dts"] - F.element_at(s, -1)["dts"] >= F.col("nominal"))
    cuts = F.aggregate("p", empty, lambda s, x: F.when(F.size(s) == 0, F.array(x)).when(far(s, x), F.array_append(s, x)).otherwise(s))
    return groups.select("archive_id", F.posexplode(cuts).alias("segment_idx", "c")).select("archive_id", F.col("segment_idx").cast("long"), F.col("c.sample_idx").alias("video_sample_start"), F.col("c.dts").alias("video_base_dts"))


def _arrow_cuts(table):
    import numpy as np
    import pyarrow as pa

    table = table.sort_by("sample_idx")
    idx, dts, nominal = (table.column(c).to_numpy() for c in ("sample_idx", "dts", "nominal"))
    cuts, at = [], 0
    while at < len(idx):
        cuts.append(at)
        at = max(at + 1, int(np.searchsorted(dts, dts[at] + nominal[0], side="left")))
    n = len(cuts)
    key = table.column("archive_id").combine_chunks().take(pa.array([0] * n))
    return pa.Table.from_arrays([key, pa.array(range(n), pa.int64()), pa.array(idx[cuts], pa.int64()), pa.array(dts[cuts], pa.int64())], names=["archive_id", "segment_idx", "video_sample_start", "video_base_dts"])


def audio_cursor(boundaries: DataFrame, audio: DataFrame) -> DataFrame:
    """boundaries with audio_sample_start, the number of audio samples that start before the tick, and audio_base_dts, their duration.

    As-of join without a nested loop: ticks and starts in one order, a boundary before an equal start, and running counts.
    """
    b = boundaries.select("archive_id", "segment_idx", F.col("target").alias("tick"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("delta"))
    a = audio.select("archive_id", F.lit(None).cast("long").alias("segment_idx"), F.col("dts").alias("tick"), F.lit(1).alias("kind"), F.col("dts_delta").alias("delta"))
    upto = by_archive().orderBy("tick", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = b.unionByName(a).withColumns({"audio_sample_start": F.sum("kind").over(upto), "audio_base_dts": F.sum("delta").over(upto)}).filter("kind = 0")
    return found.select("archive_id", "segment_idx", F.col("tick").alias("target"), "audio_sample_start", "audio_base_dts")


def precondition_error(totals: DataFrame, seconds: float) -> DataFrame:
    """(archive_id, detail): the first failed precondition of each archive, null if none fails.

    totals: archive_id, n_video, n_audio, first_sync, video_timescale, audio_timescale.
    """
    bad_duration = not math.isfinite(seconds) or seconds <= 0
    checks = (
        F.when(F.col("n_video") == 0, "video track has no samples")
        .when(F.col("n_audio") == 0, "audio track has no samples")
        .when(~F.col("first_sync"), "the video does not open with a sync sample")
        .when((F.col("video_timescale") <= 0) | (F.col("audio_timescale") <= 0), "timescale is zero")
        .when(F.lit(bad_duration), "segment duration is not a positive number")
        .when((F.col("n_video") > U32_MAX) | (F.col("n_audio") > U32_MAX), "sample count exceeds 32 bits")
    )
    return totals.select("archive_id", checks.alias("detail"))


def totals(samples: DataFrame, timescales: DataFrame) -> DataFrame:
    """One row per archive of timescales (archive_id, video_timescale, audio_timescale)."""
    video, audio = F.col("track") == "video", F.col("track") == "audio"
    counts = samples.groupBy("archive_id").agg(
        F.count_if(video).alias("n_video"), F.count_if(audio).alias("n_audio"),
        F.coalesce(F.bool_or(video & (F.col("sample_idx") == 0) & F.col("is_sync")), F.lit(False)).alias("first_sync"),
    )
    zero = {"n_video": 0, "n_audio": 0, "first_sync": False}
    return timescales.join(counts, "archive_id", "left").fillna(zero)


def all_segments(samples: DataFrame, timescales: DataFrame, seconds: float, method: str = "fold") -> DataFrame:
    """Segments of archives that meet the preconditions, those with empty segments too."""
    sums = totals(samples, timescales)
    good = sums.join(precondition_error(sums, seconds).filter("detail is null").select("archive_id"), "archive_id")
    timed = with_dts(samples.filter("track in ('video', 'audio')"))
    video = timed.filter("track = 'video'").join(good.select("archive_id", F.col("video_timescale").alias("timescale")), "archive_id")
    if not math.isfinite(seconds) or seconds <= 0:
        seconds = 1.0  # no archive is left
    cuts = sync_cuts(video, seconds, method).join(good, "archive_id")
    cuts = cuts.withColumn("target", scale_ceil(F.col("video_base_dts"), F.col("video_timescale"), F.col("audio_timescale")))
    placed = audio_cursor(cuts, timed.filter("track = 'audio'").join(good.select("archive_id"), "archive_id")).drop("target")
    rows = cuts.drop("target").join(placed, ["archive_id", "segment_idx"])
    order = by_archive().orderBy("segment_idx")
    following = lambda start, total: F.coalesce(F.lead(start).over(order), F.col(total)) - F.col(start)
    rows = rows.withColumns({"video_sample_count": following("video_sample_start", "n_video"), "audio_sample_count": following("audio_sample_start", "n_audio")})
    return rows.select("archive_id", "segment_idx", "video_sample_start", "video_sample_count", "audio_sample_start", "audio_sample_count", "video_base_dts", "audio_base_dts")


def _has_empty():
    return F.bool_or((F.col("video_sample_count") == 0) | (F.col("audio_sample_count") == 0)).over(by_archive())


def segment_table(samples: DataFrame, timescales: DataFrame, seconds: float, method: str = "fold") -> DataFrame:
    """The segments of accepted archives: one empty segment rejects its whole archive."""
    return all_segments(samples, timescales, seconds, method).withColumn("e", _has_empty()).filter("not e").drop("e")


def segment_rejects(samples: DataFrame, timescales: DataFrame, seconds: float, method: str = "fold") -> DataFrame:
    """(archive_id, variant, detail) of rejected archives; preconditions come first, then the first empty segment."""
    early = precondition_error(totals(samples, timescales), seconds).filter("detail is not null")
    rows = all_segments(samples, timescales, seconds, method)
    empty = rows.filter("video_sample_count = 0 or audio_sample_count = 0").select("archive_id").distinct().withColumn("detail", F.lit("segment has no samples of one track"))
    return early.unionByName(empty).select("archive_id", F.lit("SampleTableInconsistent").alias("variant"), "detail")


def with_segment(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """samples with the segment that holds them, by running position instead of a range join."""
    starts = segments.select("archive_id", "segment_idx", F.explode(F.array(F.struct(F.lit("video").alias("track"), F.col("video_sample_start").alias("at")), F.struct(F.lit("audio").alias("track"), F.col("audio_sample_start").alias("at")))).alias("s"))
    marks = starts.select("archive_id", "s.track", F.col("s.at").alias("sample_idx"), "segment_idx")
    w = Window.partitionBy("archive_id", "track").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = samples.join(marks, ["archive_id", "track", "sample_idx"], "left")
    return joined.withColumn("segment_idx", F.last("segment_idx", ignorenulls=True).over(w)).filter("segment_idx is not null")
