"""The driver's tables seen as media tables.

events: an archive is a user, samples are that user's events by time; see each function for the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TIMESCALE, AUDIO_TIMESCALE, AUDIO_DELTA, AUDIO_US = 1_000_000, 48_000, 1_036_800_000, 21_600_000_000
NOMINAL_SECONDS = 86_400.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def video_samples(events: DataFrame) -> DataFrame:
    """Delta: microseconds to the user's next event (last: 1 s); sync: the first and purchases; size: 100 * value."""
    order = Window.partitionBy("archive_id").orderBy("us")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.select(F.col("user_id").cast("string").alias("archive_id"), us.alias("us"), "event_id", "event_type", "value")
    return rows.select(
        "archive_id", F.lit("video").alias("track"), (F.row_number().over(order) - 1).cast("long").alias("sample_idx"),
        F.round(F.col("value") * 100).cast("long").alias("size"), F.coalesce(F.lead("us").over(order) - F.col("us"), F.lit(1_000_000)).cast("long").alias("dts_delta"),
        (F.col("event_id") % 3 - 1).cast("int").alias("cts_offset"), ((F.row_number().over(order) == 1) | (F.col("event_type") == "purchase")).alias("is_sync"),
    )


def audio_samples(video: DataFrame) -> DataFrame:
    """A cadence of six hours at 48 kHz over the video's duration; sizes and flags are constant."""
    n = video.groupBy("archive_id").agg(F.sum("dts_delta").alias("us")).select("archive_id", F.expr(f"(us + {AUDIO_US - 1}) div {AUDIO_US}").alias("n"))
    return n.filter("n > 0").select("archive_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("sample_idx")).select(
        "archive_id", F.lit("audio").alias("track"), "sample_idx", (F.lit(100) + F.col("sample_idx") % 7).cast("long").alias("size"), F.lit(AUDIO_DELTA).cast("long").alias("dts_delta"), F.lit(0).alias("cts_offset"), F.lit(True).alias("is_sync")
    )


def media(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(samples, timescales) of the events table."""
    events = read(spark, sf_dir, "events")
    video = video_samples(events.select("event_id", "ts", "user_id", "event_type", "value"))
    scales = events.select(F.col("user_id").cast("string").alias("archive_id")).distinct().select("archive_id", F.lit(TIMESCALE).cast("long").alias("video_timescale"), F.lit(AUDIO_TIMESCALE).cast("long").alias("audio_timescale"))
    return video.unionByName(audio_samples(video)), scales


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-length tables: an archive per order; a run per line: its largest quantity times its number."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    return lines.select(F.col("l_orderkey").cast("string").alias("archive_id"), F.lit("video").alias("track"), F.col("l_linenumber").cast("long").alias("run_idx"), F.col("q").cast("long").alias("count"), (F.col("l_linenumber") * 10).cast("long").alias("value"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request paths out of events: ids, file names and kinds of all sorts."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    k = F.col("event_id") % 9
    user = F.col("user_id").cast("string")
    seg = lambda n: F.format_string("seg_%04d.m4s", n)
    v = lambda i, f: F.concat(F.lit("/v/"), i, F.lit("/"), f)
    path = (
        F.when(k == 0, v(user, F.lit("playlist.m3u8"))).when(k == 1, v(user, F.lit("init.mp4"))).when(k == 2, v(user, F.lit("seg_1.m4s")))
        .when(k == 3, v(F.concat(user, F.lit(".x")), seg(F.lit(1)))).when(k == 4, v(F.concat(F.lit("u"), user), seg(F.lit(1)))).when(k == 5, F.lit("/healthz"))
        .when(k == 6, v(F.repeat(user, 33), seg(F.lit(1)))).when(k == 7, v(user, seg(F.lit(0)))).otherwise(v(user, seg(F.col("event_id") % 23 + 1)))
    )
    return e.select(F.col("event_id").alias("request_id"), path.alias("path"))
