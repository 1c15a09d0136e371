"""Queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters, rules
from .adapters import NOMINAL_SECONDS as SECONDS
from .functions import scalar
from .operators import capacity, gates, layout, lookup, sample_tables, segmenter, timeline
from .plans.staging import dealt, staged
from .schema import U32_MAX

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIDEO_SQL = """video AS (
  SELECT CAST(user_id AS VARCHAR) AS archive_id, row_number() OVER w - 1 AS sample_idx, CAST(round(value * 100) AS BIGINT) AS size,
    coalesce(epoch_us(lead(ts) OVER w) - epoch_us(ts), 1000000) AS dts_delta, CAST(event_id % 3 - 1 AS INTEGER) AS cts_offset,
    (row_number() OVER w = 1 OR event_type = 'purchase') AS is_sync
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
vdts AS (SELECT *, CAST(coalesce(sum(dts_delta) OVER (PARTITION BY archive_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS dts FROM video)"""
AUDIO_SQL = """naudio AS (SELECT archive_id, count(*) AS n_video, CAST((sum(dts_delta) + 21599999999) // 21600000000 AS BIGINT) AS n_audio FROM video GROUP BY 1),
audio AS (SELECT archive_id, k AS sample_idx, 100 + k % 7 AS size, 1036800000 AS dts_delta, k * 1036800000 AS dts
  FROM (SELECT archive_id, unnest(generate_series(0, n_audio - 1)) AS k FROM naudio))"""
CUTS_SQL = """cuts AS (
  SELECT archive_id, CAST(0 AS BIGINT) AS segment_idx, CAST(0 AS BIGINT) AS video_sample_start, CAST(0 AS BIGINT) AS video_base_dts FROM vdts WHERE sample_idx = 0
  UNION ALL
  SELECT archive_id, segment_idx, video_sample_start, video_base_dts FROM (
    SELECT c.archive_id, c.segment_idx + 1 AS segment_idx, s.sample_idx AS video_sample_start, s.dts AS video_base_dts,
      row_number() OVER (PARTITION BY c.archive_id ORDER BY s.sample_idx) AS rn
    FROM cuts c JOIN vdts s ON s.archive_id = c.archive_id AND s.is_sync AND s.sample_idx > c.video_sample_start AND s.dts - c.video_base_dts >= 86400000000) WHERE rn = 1)"""
TABLE_SQL = """targets AS (SELECT *, CAST((CAST(video_base_dts AS HUGEINT) * 48000 + 999999) // 1000000 AS BIGINT) AS target FROM cuts),
cursors AS (SELECT t.*, n.n_video, n.n_audio, least(n.n_audio, (t.target + 1036799999) // 1036800000) AS audio_sample_start FROM targets t JOIN naudio n USING (archive_id)),
allseg AS (SELECT archive_id, segment_idx, video_sample_start,
    coalesce(lead(video_sample_start) OVER w, n_video) - video_sample_start AS video_sample_count, audio_sample_start,
    coalesce(lead(audio_sample_start) OVER w, n_audio) - audio_sample_start AS audio_sample_count, video_base_dts, audio_sample_start * 1036800000 AS audio_base_dts
  FROM cursors WINDOW w AS (PARTITION BY archive_id ORDER BY segment_idx)),
seg AS (SELECT * FROM allseg WHERE archive_id NOT IN (SELECT archive_id FROM allseg WHERE video_sample_count = 0 OR audio_sample_count = 0))"""
SUMS_SQL = """vsum AS (SELECT s.archive_id, s.segment_idx, count(*) AS n_video, sum(v.size) AS video_bytes, sum(v.dts_delta) AS video_ticks
  FROM seg s JOIN vdts v ON v.archive_id = s.archive_id AND v.sample_idx >= s.video_sample_start AND v.sample_idx < s.video_sample_start + s.video_sample_count GROUP BY 1, 2),
asum AS (SELECT s.archive_id, s.segment_idx, count(*) AS n_audio, sum(a.size) AS audio_bytes
  FROM seg s JOIN audio a ON a.archive_id = s.archive_id AND a.sample_idx >= s.audio_sample_start AND a.sample_idx < s.audio_sample_start + s.audio_sample_count GROUP BY 1, 2),
sums AS (SELECT archive_id, segment_idx, CAST(n_video AS BIGINT) AS n_video, CAST(n_audio AS BIGINT) AS n_audio, CAST(video_bytes AS BIGINT) AS video_bytes,
  CAST(audio_bytes AS BIGINT) AS audio_bytes, CAST(video_ticks AS BIGINT) AS video_ticks FROM vsum JOIN asum USING (archive_id, segment_idx)),
ctts AS (SELECT archive_id, bool_or(cts_offset <> 0) AS has_ctts FROM video GROUP BY 1),
lay AS (SELECT *, CAST(156 + n_video * (CASE WHEN has_ctts THEN 12 ELSE 8 END) + 8 * n_audio AS BIGINT) AS moof_bytes,
  CAST(188 + n_video * (CASE WHEN has_ctts THEN 12 ELSE 8 END) + 8 * n_audio + video_bytes + audio_bytes AS BIGINT) AS segment_bytes FROM sums JOIN ctts USING (archive_id))"""
V = f"WITH {VIDEO_SQL} "
SEG = f"WITH RECURSIVE {VIDEO_SQL}, {AUDIO_SQL}, {CUTS_SQL}, {TABLE_SQL} "
LAY = f"WITH RECURSIVE {VIDEO_SQL}, {AUDIO_SQL}, {CUTS_SQL}, {TABLE_SQL}, {SUMS_SQL} "
RUNS_SQL = """runs AS (SELECT CAST(l_orderkey AS VARCHAR) AS archive_id, CAST(l_linenumber AS BIGINT) AS run_idx, CAST(max(l_quantity) AS BIGINT) AS cnt, CAST(l_linenumber * 10 AS BIGINT) AS value
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
rows_ AS (SELECT archive_id, run_idx, value, row_number() OVER (PARTITION BY archive_id ORDER BY run_idx, k) - 1 AS sample_idx FROM (SELECT *, unnest(generate_series(1, cnt)) AS k FROM runs))"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _media(spark, sf_dir):
    """(samples with their decode times, written once for the branches that read them, time scales)."""
    samples, scales = adapters.media(spark, sf_dir)
    return staged(timeline.with_dts(samples), "timed"), scales


def _segments(spark, sf_dir):
    samples, scales = _media(spark, sf_dir)
    return samples, scales, segmenter.segment_table(samples, scales, SECONDS)


def _sums(spark, sf_dir):
    samples, scales, segments = _segments(spark, sf_dir)
    segments = staged(segments, "segments")
    placed = segmenter.with_segment(samples.join(segments.select("archive_id").distinct(), "archive_id", "left_semi"), segments)
    return samples, scales, layout.payload_sums(placed)


def _layout(spark, sf_dir):
    samples, scales, sums = _sums(spark, sf_dir)
    ctts = timeline.track_flags(samples.filter("track = 'video'"))
    return scales, layout.segment_layout(sums, ctts)


@query(V + "SELECT archive_id, sample_idx, dts FROM vdts")
def dts_prefix_sum(spark, sf_dir):
    return timeline.with_dts(adapters.video_samples(adapters.read(spark, sf_dir, "events"))).select("archive_id", "sample_idx", "dts")


@query(V + "SELECT archive_id, sample_idx, dts + cts_offset AS pts FROM vdts")
def pts(spark, sf_dir):
    return timeline.with_pts(adapters.video_samples(adapters.read(spark, sf_dir, "events"))).select("archive_id", "sample_idx", "pts")


def _cuts(spark, sf_dir, method):
    video = timeline.with_dts(adapters.video_samples(adapters.read(spark, sf_dir, "events"))).withColumn("timescale", F.lit(adapters.TIMESCALE))
    return segmenter.sync_cuts(video, SECONDS, method)


CUTS = f"WITH RECURSIVE {VIDEO_SQL}, {CUTS_SQL} SELECT * FROM cuts"


@query(CUTS)
def segment_cuts(spark, sf_dir):
    return _cuts(spark, sf_dir, "fold")


@query(CUTS)
def segment_cuts_arrow(spark, sf_dir):
    return _cuts(spark, sf_dir, "arrow")


@query(SEG + "SELECT * FROM seg")
def segment_table(spark, sf_dir):
    return _segments(spark, sf_dir)[2]


@query(SEG + "SELECT DISTINCT archive_id, 'SampleTableInconsistent' AS variant, 'segment has no samples of one track' AS detail FROM allseg WHERE video_sample_count = 0 OR audio_sample_count = 0")
def segment_rejects(spark, sf_dir):
    samples, scales = _media(spark, sf_dir)
    return segmenter.segment_rejects(samples, scales, SECONDS)


@query(SEG + "SELECT archive_id, segment_idx, target, audio_sample_start, audio_sample_start * 1036800000 AS audio_base_dts FROM cursors")
def audio_boundary(spark, sf_dir):
    timed, scales = _media(spark, sf_dir)
    video = timed.filter("track = 'video'").withColumn("timescale", F.lit(adapters.TIMESCALE))
    cuts = segmenter.sync_cuts(video, SECONDS).join(scales, "archive_id").withColumn("target", scalar.scale_ceil(F.col("video_base_dts"), F.col("video_timescale"), F.col("audio_timescale")))
    return segmenter.audio_cursor(cuts, timed.filter("track = 'audio'"))


@query("SELECT event_id, CAST((CAST(epoch_us(ts) AS HUGEINT) * 48000 + 999999) // 1000000 AS BIGINT) AS scaled, CAST(greatest(1, ceil(1.1::DOUBLE * (event_id % 90000 + 1))) AS BIGINT) AS nominal FROM events")
def scale_ceil(spark, sf_dir):
    e = adapters.read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select("event_id", scalar.scale_ceil(us, F.lit(1_000_000).cast("long"), F.lit(48_000).cast("long")).alias("scaled"), scalar.nominal_ticks(1.1, F.col("event_id") % 90000 + 1).alias("nominal"))


@query(LAY + "SELECT archive_id, segment_idx, video_ticks FROM sums")
def segment_ticks(spark, sf_dir):
    return _sums(spark, sf_dir)[2].select("archive_id", "segment_idx", "video_ticks")


@query(LAY + "SELECT archive_id, segment_idx, printf('%.6f', video_ticks / 1000000.0::DOUBLE) AS extinf, printf('seg_%04d.m4s', segment_idx + 1) AS uri FROM sums")
def extinf(spark, sf_dir):
    _, scales, sums = _sums(spark, sf_dir)
    return layout.playlist_entries(sums, scales)


@query(LAY + "SELECT n.archive_id, CAST(coalesce((max(s.video_ticks) + 999999) // 1000000, 0) AS BIGINT) AS target_duration FROM naudio n LEFT JOIN sums s USING (archive_id) GROUP BY 1")
def target_duration(spark, sf_dir):
    _, scales, sums = _sums(spark, sf_dir)
    return layout.target_duration(sums, scales)


@query(
    LAY
    + """SELECT n.archive_id, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST(coalesce((max(s.video_ticks) + 999999) // 1000000, 0) AS BIGINT) || chr(10)
 || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10) || '#EXT-X-MAP:URI="init.mp4"' || chr(10)
 || coalesce(string_agg('#EXTINF:' || printf('%.6f', s.video_ticks / 1000000.0::DOUBLE) || ',' || chr(10) || printf('seg_%04d.m4s', s.segment_idx + 1) || chr(10), '' ORDER BY s.segment_idx), '') || '#EXT-X-ENDLIST' || chr(10) AS playlist
FROM naudio n LEFT JOIN sums s USING (archive_id) GROUP BY 1"""
)
def playlist_text(spark, sf_dir):
    _, scales, sums = _sums(spark, sf_dir)
    return layout.playlist_text(sums, scales)


@query(LAY + "SELECT archive_id, segment_idx, n_video, n_audio, video_bytes, audio_bytes, video_ticks FROM sums")
def payload_sums(spark, sf_dir):
    return _sums(spark, sf_dir)[2]


@query(LAY + "SELECT archive_id, segment_idx, moof_bytes, segment_bytes FROM lay")
def segment_bytes(spark, sf_dir):
    return _layout(spark, sf_dir)[1].select("archive_id", "segment_idx", "moof_bytes", "segment_bytes")


@query(LAY + "SELECT archive_id, segment_idx, least(segment_idx + 1, 4294967295) AS sequence_number, moof_bytes + 8 AS video_data_offset, moof_bytes + 8 + video_bytes AS audio_data_offset FROM lay")
def data_offsets(spark, sf_dir):
    return _layout(spark, sf_dir)[1].select("archive_id", "segment_idx", "sequence_number", "video_data_offset", "audio_data_offset")


@query(LAY + "SELECT archive_id, max(segment_bytes) AS max_segment_size FROM lay GROUP BY 1")
def max_segment_size(spark, sf_dir):
    return layout.max_segment_size(_layout(spark, sf_dir)[1])


@query(V + "SELECT archive_id, count(*) AS n_samples, bool_or(cts_offset <> 0) AS has_ctts FROM video GROUP BY 1")
def has_ctts(spark, sf_dir):
    return timeline.track_flags(adapters.video_samples(adapters.read(spark, sf_dir, "events"))).select("archive_id", "n_samples", "has_ctts")


@query(V + "SELECT archive_id, bool_and(is_sync) AS all_sync, CASE WHEN bool_and(is_sync) THEN 'note: every video sample is a sync sample' END AS note FROM video GROUP BY 1")
def all_sync_note(spark, sf_dir):
    flags = timeline.track_flags(adapters.video_samples(adapters.read(spark, sf_dir, "events")))
    return flags.select("archive_id", "all_sync", F.when(F.col("all_sync"), "note: every video sample is a sync sample").alias("note"))


@query(f"WITH {RUNS_SQL} SELECT archive_id, sample_idx, value FROM rows_")
def rle_expand(spark, sf_dir):
    return sample_tables.expand_runs(adapters.runs(spark, sf_dir)).select("archive_id", "sample_idx", "value")


@query(
    f"""WITH {RUNS_SQL}, n AS (SELECT archive_id, sum(cnt) AS total, sum(cnt) + CAST(archive_id AS BIGINT) % 3 - 1 AS n FROM runs GROUP BY 1)
SELECT archive_id, CASE WHEN total > n THEN 'stts runs exceed the sample count' ELSE 'stts runs fall short of the sample count' END AS detail FROM n WHERE total <> n"""
)
def rle_total_check(spark, sf_dir):
    runs = adapters.runs(spark, sf_dir)
    counts = runs.groupBy("archive_id", "track").agg((F.sum("count") + F.col("archive_id").cast("long") % 3 - 1).alias("n"))
    return sample_tables.run_total_check(runs, counts, "stts").select("archive_id", "detail")


STSC_SQL = """stsc AS (SELECT CAST(l_orderkey AS VARCHAR) AS archive_id, CAST(l_linenumber AS BIGINT) AS entry_idx, CAST(max(l_quantity) AS BIGINT) AS spc FROM lineitem GROUP BY l_orderkey, l_linenumber),
ranged AS (SELECT archive_id, entry_idx, spc, 1 + coalesce(sum(entry_idx) OVER (PARTITION BY archive_id ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_chunk FROM stsc),
ended AS (SELECT *, coalesce(lead(first_chunk) OVER (PARTITION BY archive_id ORDER BY entry_idx), first_chunk + entry_idx) AS end_chunk FROM ranged),
chunks AS (SELECT archive_id, CAST(c - 1 AS BIGINT) AS chunk_idx, spc AS samples_per_chunk FROM (SELECT archive_id, spc, unnest(generate_series(CAST(first_chunk AS BIGINT), CAST(end_chunk - 1 AS BIGINT))) AS c FROM ended)),
placed AS (SELECT archive_id, chunk_idx, row_number() OVER (PARTITION BY archive_id ORDER BY chunk_idx, k) - 1 AS sample_idx FROM (SELECT *, unnest(generate_series(1, samples_per_chunk)) AS k FROM chunks)),
sized AS (SELECT *, 50 + sample_idx % 97 AS size FROM placed),
offs AS (SELECT archive_id, sample_idx, chunk_idx, size, CAST(chunk_idx * 1000000 + coalesce(sum(size) OVER (PARTITION BY archive_id, chunk_idx ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM sized)"""


def _chunks(spark, sf_dir):
    """stsc entries: an archive per order, an entry per line, covering as many chunks as the line's number."""
    from pyspark.sql import Window

    runs = adapters.runs(spark, sf_dir)
    before = Window.partitionBy("archive_id").orderBy("run_idx").rowsBetween(Window.unboundedPreceding, -1)
    stsc = runs.select("archive_id", "track", F.col("run_idx").alias("entry_idx"), (1 + F.coalesce(F.sum("run_idx").over(before), F.lit(0))).alias("first_chunk"), F.col("count").alias("samples_per_chunk"), F.lit(1).alias("sample_description_index"))
    counts = stsc.groupBy("archive_id", "track").agg(F.sum("entry_idx").alias("chunk_count"))
    return sample_tables.chunk_samples(sample_tables.stsc_ranges(stsc, counts))


def _tables(spark, sf_dir, n: str, sync=False):
    """An order's lines as the sample tables of a track: n samples of sizes 50 to 146, in chunks a million bytes apart."""
    run = F.struct("run_idx", "count", "value")
    rows = adapters.runs(spark, sf_dir).groupBy("archive_id", "track").agg(F.array_sort(F.collect_list(run)).alias("stts"))
    total = lambda of: F.expr(f"aggregate(stts, cast(0 as bigint), (a, r) -> a + {of})")
    rows = rows.withColumns({"n": total(n), "chunk_count": total("r.run_idx")})
    odd = F.col("archive_id").cast("long")
    return rows.select(
        "archive_id", "track", F.expr("transform(sequence(cast(0 as bigint), n - 1), k -> 50 + k % 97)").alias("sizes"), "stts",
        F.when(odd % 2 == 0, F.expr("transform(stts, r -> named_struct('count', r.count, 'value', r.run_idx - 4))")).alias("ctts"),
        F.expr("transform(stts, (r, i) -> named_struct('first_chunk', 1 + aggregate(slice(stts, 1, i), cast(0 as bigint), (a, q) -> a + q.run_idx), 'samples_per_chunk', r.count))").alias("stsc"),
        F.expr("transform(sequence(cast(0 as bigint), chunk_count - 1), c -> c * 1000000)").alias("chunks"),
        F.when(odd % 4 != 0, F.expr("transform(stts, r -> r.count)")).alias("stss") if sync else F.lit(None).cast("array<bigint>").alias("stss"),
    )


@query(f"WITH {STSC_SQL} SELECT archive_id, chunk_idx, samples_per_chunk FROM chunks")
def stsc_expand(spark, sf_dir):
    return _chunks(spark, sf_dir).select("archive_id", "chunk_idx", "samples_per_chunk")


@query(f'WITH {STSC_SQL} SELECT archive_id, sample_idx, chunk_idx, size, "offset" FROM offs')
def sample_offsets(spark, sf_dir):
    return sample_tables.expand_tables(_tables(spark, sf_dir, "r.run_idx * r.count"), fields=()).select("archive_id", "sample_idx", "chunk_idx", "size", "offset")


def _sync_tables(spark, sf_dir):
    orders = adapters.runs(spark, sf_dir).select("archive_id", "track").distinct()
    tables = orders.withColumn("stss_absent", F.col("archive_id").cast("long") % 4 == 0)
    stss = adapters.runs(spark, sf_dir).filter(F.col("archive_id").cast("long") % 4 != 0).select("archive_id", "track", F.col("count").alias("sample_number"))
    return stss, tables


SYNC_SQL = "(CAST(r.archive_id AS BIGINT) % 4 = 0 OR r.sample_idx + 1 IN (SELECT cnt FROM runs q WHERE q.archive_id = r.archive_id))"
SYNC_JOIN = "LEFT JOIN (SELECT DISTINCT archive_id, cnt - 1 AS sample_idx FROM runs) q USING (archive_id, sample_idx)"


@query(f"WITH {RUNS_SQL} SELECT r.archive_id, r.sample_idx, (CAST(r.archive_id AS BIGINT) % 4 = 0 OR q.archive_id IS NOT NULL) AS is_sync FROM rows_ r LEFT JOIN (SELECT DISTINCT archive_id, cnt - 1 AS sample_idx FROM runs) q ON q.archive_id = r.archive_id AND q.sample_idx = r.sample_idx")
def sync_flags(spark, sf_dir):
    stss, tables = _sync_tables(spark, sf_dir)
    rows = sample_tables.expand_runs(adapters.runs(spark, sf_dir)).drop("value")
    return sample_tables.with_sync(rows, stss, tables).select("archive_id", "sample_idx", "is_sync")


@query(
    f"""WITH {RUNS_SQL}, {STSC_SQL}, total AS (SELECT archive_id, count(*) AS n FROM rows_ GROUP BY 1)
SELECT o.archive_id, o.sample_idx, o."offset", o.size, r.value AS dts_delta, CAST(CASE WHEN CAST(o.archive_id AS BIGINT) % 2 = 0 THEN r.run_idx - 4 ELSE 0 END AS INTEGER) AS cts_offset,
 (CAST(r.archive_id AS BIGINT) % 4 = 0 OR q.archive_id IS NOT NULL) AS is_sync
FROM offs o JOIN rows_ r ON r.archive_id = o.archive_id AND r.sample_idx = o.sample_idx
LEFT JOIN (SELECT DISTINCT archive_id, cnt - 1 AS sample_idx FROM runs) q ON q.archive_id = o.archive_id AND q.sample_idx = o.sample_idx"""
)
def sample_assembly(spark, sf_dir):
    rows = sample_tables.expand_tables(_tables(spark, sf_dir, "r.count", sync=True))
    return rows.select("archive_id", "sample_idx", "offset", "size", "dts_delta", "cts_offset", "is_sync")


@query(
    """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS archive_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'vide' WHEN '2-HIGH' THEN 'soun' WHEN '3-MEDIUM' THEN 'vide' ELSE 'soun' END AS handler FROM orders),
c AS (SELECT archive_id, count(*) AS n_tracks, count(*) FILTER (WHERE handler = 'vide') AS n_video, count(*) FILTER (WHERE handler = 'soun') AS n_audio FROM t GROUP BY 1)
SELECT *, CASE WHEN NOT (n_tracks = 2 AND n_video = 1 AND n_audio = 1) THEN 'UnsupportedTrackLayout' END AS variant FROM c"""
)
def track_classify(spark, sf_dir):
    p = F.col("o_orderpriority")
    tracks = adapters.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("archive_id"), F.when(p.isin("1-URGENT", "3-MEDIUM"), "vide").otherwise("soun").alias("handler"))
    return gates.classify_tracks(tracks)


@query(
    """WITH p AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'isom' WHEN 1 THEN 'qt  ' WHEN 2 THEN 'mp41' WHEN 3 THEN 'M4V ' ELSE 'abcd' END AS major,
 CASE WHEN p_partkey % 3 = 0 THEN ['iso6', 'zzzz'] WHEN p_partkey % 3 = 1 THEN ['zzzz'] ELSE [] END AS compat, 8 + p_partkey % 7 AS len FROM part)
SELECT p_partkey, CASE WHEN len < 8 THEN 'MalformedAtom' WHEN major IN ('isom','mp42','iso2','iso4','iso5','iso6','cmfc','mp41') THEN NULL WHEN (len - 8) % 4 <> 0 THEN 'MalformedAtom'
 WHEN list_contains(compat, 'iso6') THEN NULL ELSE 'UnsupportedBrand' END AS variant FROM p"""
)
def brand_gate(spark, sf_dir):
    s, k = F.col("p_size") % 5, F.col("p_partkey") % 3
    major = F.when(s == 0, "isom").when(s == 1, "qt  ").when(s == 2, "mp41").when(s == 3, "M4V ").otherwise("abcd")
    compat = F.when(k == 0, F.array(F.lit("iso6"), F.lit("zzzz"))).when(k == 1, F.array(F.lit("zzzz"))).otherwise(F.array().cast("array<string>"))
    return adapters.read(spark, sf_dir, "part").select("p_partkey", gates.brand_error(major, compat, 8 + F.col("p_partkey") % 7).alias("variant"))


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'vide' WHEN 1 THEN 'soun' ELSE 'text' END AS handler, CASE p_size % 4 WHEN 0 THEN 'avc1' WHEN 1 THEN 'mp4a' WHEN 2 THEN 'hev1' ELSE 'vp09' END AS fourcc,
 (p_size % 11 = 0) AS marked FROM part)
SELECT p_partkey, CASE WHEN handler <> 'text' AND marked THEN 'EncryptedInput' WHEN handler = 'vide' AND fourcc NOT IN ('avc1','hvc1','hev1') THEN 'UnsupportedVideoCodec'
 WHEN handler = 'soun' AND fourcc <> 'mp4a' THEN 'UnsupportedAudioCodec' END AS variant FROM p"""
)
def codec_gate(spark, sf_dir):
    k, s = F.col("p_partkey") % 3, F.col("p_size") % 4
    handler = F.when(k == 0, "vide").when(k == 1, "soun").otherwise("text")
    code = F.when(s == 0, "avc1").when(s == 1, "mp4a").when(s == 2, "hev1").otherwise("vp09")
    children = F.when(F.col("p_size") % 11 == 0, F.array(F.lit("pasp"), F.lit("sinf"))).otherwise(F.array(F.lit("pasp")))
    return adapters.read(spark, sf_dir, "part").select("p_partkey", gates.codec_error(handler, code, children).alias("variant"))


IDS_SQL = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'a-' || page_id WHEN 1 THEN '' WHEN 2 THEN repeat('x', 60 + CAST(page_id % 9 AS INTEGER)) WHEN 3 THEN '../' || page_id WHEN 4 THEN page_id || chr(10) ELSE 'id_' || page_id || '.x' END AS id FROM pages"""


@query(f"WITH i AS ({IDS_SQL}) SELECT page_id, CASE WHEN strlen(id) = 0 THEN 'empty' WHEN strlen(id) > 64 THEN 'too_long' WHEN NOT regexp_full_match(id, '[A-Za-z0-9_-]+') THEN 'bad_chars' ELSE 'ok' END AS status FROM i")
def id_validate(spark, sf_dir):
    k, p = F.col("page_id") % 6, F.col("page_id").cast("string")
    value = (
        F.when(k == 0, F.concat(F.lit("a-"), p)).when(k == 1, "").when(k == 2, F.repeat(F.lit("x"), (60 + F.col("page_id") % 9).cast("int")))
        .when(k == 3, F.concat(F.lit("../"), p)).when(k == 4, F.concat(p, F.lit("\n"))).otherwise(F.concat(F.lit("id_"), p, F.lit(".x")))
    )
    return adapters.read(spark, sf_dir, "pages").select("page_id", scalar.id_status(value).alias("status"))


NAMES_SQL = """SELECT event_id, CASE event_id % 7 WHEN 0 THEN printf('seg_%04d.m4s', event_id) WHEN 1 THEN 'seg_' || event_id % 1000 || '.m4s' WHEN 2 THEN printf('seg_%08d.m4s', event_id) WHEN 3 THEN printf('SEG_%04d.m4s', event_id)
 WHEN 4 THEN printf('seg_%04d.mp4', event_id) WHEN 5 THEN 'seg_' || (4294967290 + event_id % 12) || '.m4s' ELSE 'seg_0000.m4s' END AS name FROM events"""


@query(f"WITH n AS ({NAMES_SQL}), d AS (SELECT event_id, TRY_CAST(nullif(regexp_extract(name, '^seg_([0-9][0-9][0-9][0-9]+)\\.m4s$', 1), '') AS HUGEINT) AS d FROM n) SELECT event_id, CASE WHEN d >= 1 AND d <= 4294967295 THEN CAST(d - 1 AS BIGINT) END AS segment_idx FROM d")
def segment_name_parse(spark, sf_dir):
    e, k = F.col("event_id"), F.col("event_id") % 7
    name = (
        F.when(k == 0, F.format_string("seg_%04d.m4s", e)).when(k == 1, F.concat(F.lit("seg_"), (e % 1000).cast("string"), F.lit(".m4s"))).when(k == 2, F.format_string("seg_%08d.m4s", e)).when(k == 3, F.format_string("SEG_%04d.m4s", e))
        .when(k == 4, F.format_string("seg_%04d.mp4", e)).when(k == 5, F.concat(F.lit("seg_"), (4294967290 + e % 12).cast("string"), F.lit(".m4s"))).otherwise("seg_0000.m4s")
    )
    return adapters.read(spark, sf_dir, "events").select("event_id", scalar.segment_index(name).alias("segment_idx"))


def _catalogue(segments):
    n = F.col("archive_id").cast("long")
    counts = segments.groupBy("archive_id").agg(F.count(F.lit(1)).alias("n_segments"))
    return counts.select(F.col("archive_id").alias("id"), F.lit(True).alias("has_index"), (n % 11 != 0).alias("has_source"), (n % 13 != 0).alias("length_matches"), "n_segments")


def _resolved(spark, sf_dir):
    return lookup.resolve(adapters.requests(spark, sf_dir), _catalogue(_segments(spark, sf_dir)[2]))


REQUEST_SQL = """req AS (SELECT event_id AS request_id, CAST(user_id AS VARCHAR) AS u, event_id % 9 AS k, event_id % 23 AS q FROM events),
cat AS (SELECT archive_id, count(*) AS n_segments, CAST(archive_id AS BIGINT) AS n FROM seg GROUP BY 1),
res AS (SELECT request_id, CASE k WHEN 0 THEN 'playlist' WHEN 1 THEN 'init' WHEN 5 THEN 'health' ELSE 'segment' END AS kind,
 CASE WHEN k IN (3, 4, 6) THEN CAST(0 AS BIGINT) WHEN k = 8 THEN CAST(q AS BIGINT) END AS segment_idx,
 CASE WHEN k = 5 THEN 200 WHEN k IN (2, 7) THEN 404 WHEN k = 3 THEN 400 WHEN k = 4 THEN 404 WHEN k = 6 AND length(u) * 33 > 64 THEN 400 WHEN k = 6 THEN 404 WHEN cat.n IS NULL THEN 404 WHEN n % 11 = 0 OR n % 13 = 0 THEN 500
  WHEN k = 8 AND q >= n_segments THEN 404 ELSE 200 END AS status
 FROM req LEFT JOIN cat ON cat.archive_id = req.u)"""


@query(SEG.rstrip() + f", {REQUEST_SQL} SELECT request_id, kind, segment_idx, status FROM res")
def request_status(spark, sf_dir):
    return _resolved(spark, sf_dir).select("request_id", "kind", "segment_idx", "status")


@query(
    SEG.rstrip()
    + f""", {REQUEST_SQL} SELECT request_id, CASE WHEN status = 200 AND kind = 'playlist' THEN 'public, max-age=300' WHEN status = 200 AND kind IN ('init', 'segment') THEN 'public, max-age=31536000, immutable' END AS cache_control,
 CASE WHEN status = 200 AND kind = 'playlist' THEN 'application/vnd.apple.mpegurl' WHEN status = 200 AND kind IN ('init', 'segment') THEN 'video/mp4' END AS content_type,
 CASE status WHEN 400 THEN 'bad request' WHEN 404 THEN 'not found' WHEN 500 THEN 'internal error' END AS body FROM res"""
)
def cache_policy(spark, sf_dir):
    return _resolved(spark, sf_dir).select("request_id", "cache_control", "content_type", "body")


@query(SEG.rstrip() + f", {REQUEST_SQL} SELECT CAST(n AS VARCHAR) AS archive, CASE WHEN n % 11 = 0 OR n % 13 = 0 THEN 500 ELSE 200 END AS status FROM cat")
def length_mismatch(spark, sf_dir):
    """A request for each archive of which some have lost their source, or have one of another length."""
    catalogue = _catalogue(_segments(spark, sf_dir)[2])
    requests = catalogue.select(F.col("id").alias("request_id"), F.concat(F.lit("/v/"), F.col("id"), F.lit("/init.mp4")).alias("path"))
    return lookup.resolve(requests, catalogue).select(F.col("request_id").alias("archive"), "status")


def _hosts(spark, sf_dir):
    n = F.col("c_custkey")
    return adapters.read(spark, sf_dir, "customer").select(
        n.alias("host"), F.when(n % 4 != 0, n * 1013).alias("max_map_count"), F.when(n % 5 != 0, n * 123_456_789).alias("mem_total"), F.when(n % 6 == 0, n).alias("open_flag"), F.when(n % 7 == 0, n).alias("inflight_flag")
    )


HOSTS_SQL = """hosts AS (SELECT c_custkey AS host, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 1013 END AS vma, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 123456789 END AS mem,
 CASE WHEN c_custkey % 6 = 0 THEN c_custkey END AS oflag, CASE WHEN c_custkey % 7 = 0 THEN c_custkey END AS iflag FROM customer),
k AS (SELECT host, vma, CAST(coalesce(oflag, least(greatest(greatest(vma - 2048, 0) // 2, 64), 100000), 1024) AS BIGINT) AS max_open, CASE WHEN oflag IS NOT NULL THEN 'flag' WHEN vma IS NOT NULL THEN 'auto' ELSE 'fallback' END AS open_source,
 CAST(coalesce(iflag, least(greatest((mem * 5 // 100) // 33554432, 64), 4096), 64) AS BIGINT) AS max_inflight, CASE WHEN iflag IS NOT NULL THEN 'flag' WHEN mem IS NOT NULL THEN 'auto' ELSE 'fallback' END AS inflight_source FROM hosts)"""
# greatest and least skip nulls in DuckDB as in Spark; the automatic value must stay null without its input
HOSTS_SQL = HOSTS_SQL.replace("least(greatest(greatest(vma - 2048, 0) // 2, 64), 100000)", "CASE WHEN vma IS NOT NULL THEN least(greatest(greatest(vma - 2048, 0) // 2, 64), 100000) END").replace(
    "least(greatest((mem * 5 // 100) // 33554432, 64), 4096)", "CASE WHEN mem IS NOT NULL THEN least(greatest((mem * 5 // 100) // 33554432, 64), 4096) END"
)


@query(f"WITH {HOSTS_SQL} SELECT host, max_open, vma >= 2 * max_open + 2048 AS map_ok FROM k")
def auto_max_open(spark, sf_dir):
    return capacity.knobs(_hosts(spark, sf_dir)).select("host", "max_open", "map_ok")


@query(f"WITH {HOSTS_SQL} SELECT host, max_inflight FROM k")
def auto_inflight(spark, sf_dir):
    return capacity.knobs(_hosts(spark, sf_dir)).select("host", "max_inflight")


@query(f"WITH {HOSTS_SQL} SELECT host, open_source, inflight_source, printf('max_open_archives=%d (%s) max_inflight=%d (%s)', max_open, open_source, max_inflight, inflight_source) AS audit FROM k")
def knob_source(spark, sf_dir):
    return capacity.audit_line(capacity.knobs(_hosts(spark, sf_dir))).select("host", "open_source", "inflight_source", "audit")


@query(LAY.rstrip() + f", {HOSTS_SQL}, big AS (SELECT max(segment_bytes) AS b FROM lay) SELECT host, max_inflight * b AS inflight_bytes FROM k, big")
def inflight_ram_bound(spark, sf_dir):
    largest = layout.max_segment_size(_layout(spark, sf_dir)[1]).agg(F.max("max_segment_size").alias("b"))
    return capacity.knobs(_hosts(spark, sf_dir)).crossJoin(F.broadcast(largest)).select("host", (F.col("max_inflight") * F.col("b")).alias("inflight_bytes"))  # one row


@query(
    LAY
    + """SELECT n.archive_id, CAST(168 + 2 * 24 + 2 * 8 + 24 * (n.n_video + n.n_audio) + 8 + 32 * count(s.segment_idx) AS BIGINT) AS index_bytes
FROM naudio n JOIN seg s USING (archive_id) GROUP BY n.archive_id, n.n_video, n.n_audio"""
)
def idx_size_estimate(spark, sf_dir):
    samples, _, segments = _segments(spark, sf_dir)
    n = samples.groupBy("archive_id").agg(F.count(F.lit(1)).alias("n"))
    return segments.groupBy("archive_id").agg(F.count(F.lit(1)).alias("s")).join(n, "archive_id").select("archive_id", (168 + 2 * 24 + 2 * 8 + 24 * F.col("n") + 8 + 32 * F.col("s")).cast("long").alias("index_bytes"))


@query(
    """WITH t AS (SELECT event_type AS host, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, event_id AS seq, CAST(user_id % 40 AS VARCHAR) AS id FROM events),
p AS (SELECT *, lag(pos) OVER (PARTITION BY host, id ORDER BY pos) AS prev FROM t)
SELECT p.host, p.seq, p.id, (p.prev IS NOT NULL AND (SELECT count(DISTINCT q.id) FROM t q WHERE q.host = p.host AND q.pos > p.prev AND q.pos < p.pos) < 16) AS hit FROM p"""
)
def lru_hits(spark, sf_dir):
    trace = adapters.read(spark, sf_dir, "events").select(F.col("event_type").alias("host"), F.col("event_id").alias("seq"), (F.col("user_id") % 40).cast("string").alias("id"))
    return capacity.replay_lru(trace, 16)


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def digest_sha2(spark, sf_dir):
    return adapters.read(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@query(
    LAY
    + """, m AS (SELECT s.archive_id, s.segment_idx, 'video' AS track, 0 AS r, v.sample_idx, v.size FROM seg s JOIN vdts v ON v.archive_id = s.archive_id AND v.sample_idx >= s.video_sample_start AND v.sample_idx < s.video_sample_start + s.video_sample_count
 UNION ALL SELECT s.archive_id, s.segment_idx, 'audio', 1, a.sample_idx, a.size FROM seg s JOIN audio a ON a.archive_id = s.archive_id AND a.sample_idx >= s.audio_sample_start AND a.sample_idx < s.audio_sample_start + s.audio_sample_count)
SELECT archive_id, segment_idx, track, sample_idx, CAST(row_number() OVER w - 1 AS INTEGER) AS "position",
 CAST(coalesce(sum(size) OVER (PARTITION BY archive_id, segment_idx ORDER BY r, sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS payload_offset
FROM m WINDOW w AS (PARTITION BY archive_id, segment_idx ORDER BY r, sample_idx)"""
)
def mux_order(spark, sf_dir):
    samples, _, segments = _segments(spark, sf_dir)
    segments = staged(segments, "segments")
    placed = segmenter.with_segment(samples.join(segments.select("archive_id").distinct(), "archive_id", "left_semi"), segments)
    return layout.mux_order(placed).select("archive_id", "segment_idx", "track", "sample_idx", "position", "payload_offset")


# Byte-level queries: each user's events as a small archive file, made, scanned, indexed and read back.

#: Ticks of each archive's video, cuts in them, and segments; as VIDEO_SQL to SUMS_SQL, with a timescale t for each archive.
TICKS_SQL = f"""{VIDEO_SQL}, {AUDIO_SQL},
scale AS (SELECT archive_id, coalesce(max(t) FILTER (WHERE CAST(most AS HUGEINT) * t // 1000000 < 4294967295), 1) AS t, coalesce(max(nominal) FILTER (WHERE CAST(most AS HUGEINT) * t // 1000000 < 4294967295), 86400) AS nominal
  FROM (SELECT archive_id, max(dts_delta) AS most FROM video GROUP BY 1),
   (SELECT CAST(pow(2, a) * pow(5, b) AS BIGINT) AS t, CAST(86400 * pow(2, a) * pow(5, b) AS BIGINT) AS nominal FROM range(7) x(a), range(7) y(b)) GROUP BY 1),
tv AS (SELECT v.archive_id, sample_idx, size, cts_offset, is_sync, t, nominal, CAST(CAST(dts AS HUGEINT) * t // 1000000 AS BIGINT) AS dts,
   CAST(CAST(dts + dts_delta AS HUGEINT) * t // 1000000 - CAST(dts AS HUGEINT) * t // 1000000 AS BIGINT) AS dts_delta FROM vdts v JOIN scale USING (archive_id)),
tcuts AS (
  SELECT archive_id, t, CAST(0 AS BIGINT) AS segment_idx, CAST(0 AS BIGINT) AS video_sample_start, CAST(0 AS BIGINT) AS video_base_dts FROM tv WHERE sample_idx = 0
  UNION ALL
  SELECT archive_id, t, segment_idx, video_sample_start, video_base_dts FROM (
    SELECT c.archive_id, c.t, c.segment_idx + 1 AS segment_idx, s.sample_idx AS video_sample_start, s.dts AS video_base_dts, row_number() OVER (PARTITION BY c.archive_id ORDER BY s.sample_idx) AS rn
    FROM tcuts c JOIN tv s ON s.archive_id = c.archive_id AND s.is_sync AND s.sample_idx > c.video_sample_start AND s.dts - c.video_base_dts >= s.nominal) WHERE rn = 1),
tcursor AS (SELECT c.*, n_video, n_audio, least(n_audio, ((CAST(video_base_dts AS HUGEINT) * 48000 + t - 1) // t + 1036799999) // 1036800000)::BIGINT AS audio_sample_start FROM tcuts c JOIN naudio USING (archive_id)),
tall AS (SELECT *, coalesce(lead(video_sample_start) OVER w, n_video) - video_sample_start AS video_sample_count, coalesce(lead(audio_sample_start) OVER w, n_audio) - audio_sample_start AS audio_sample_count
  FROM tcursor WINDOW w AS (PARTITION BY archive_id ORDER BY segment_idx)),
tseg AS (SELECT * FROM tall WHERE archive_id NOT IN (SELECT archive_id FROM tall WHERE video_sample_count = 0 OR audio_sample_count = 0)),
flags AS (SELECT archive_id, bool_or(cts_offset <> 0) AS has_ctts, count(*) FILTER (WHERE is_sync) AS n_sync, sum(size) AS v_bytes, sum(dts_delta) AS v_ticks, max(t) AS t FROM tv GROUP BY 1),
asize AS (SELECT archive_id, sum(size) AS a_bytes FROM audio GROUP BY 1),
-- sizes of the boxes that grow with the tables: stts, stsz, stss, ctts of video; stts, stsz of audio
grow AS (SELECT *, 102 + (16 + 8 * n_video) + 28 + (20 + 4 * n_video) + 24 + (16 + 4 * n_sync) + (16 + 8 * n_video) + 8 AS v_stbl, 52 + (16 + 8 * n_audio) + 28 + (20 + 4 * n_audio) + 24 + 8 AS a_stbl
  FROM flags JOIN naudio USING (archive_id) JOIN asize USING (archive_id)),
file AS (SELECT *, CAST(20 + 8 + 2 * (8 + 92 + 8 + 32 + 33 + 8) + v_stbl + a_stbl + 8 AS BIGINT) AS payload_at, CAST(20 + 8 + 2 * (8 + 92 + 8 + 32 + 33 + 8) + v_stbl + a_stbl + 8 + v_bytes + a_bytes AS BIGINT) AS source_len FROM grow)"""
BYTES = f"WITH RECURSIVE {TICKS_SQL} "
#: Samples of each segment in payload order, and what they add up to; hexadecimal rows and payload.
PARTS_SQL = """part AS (
  SELECT s.archive_id, s.segment_idx, 1 AS r, v.sample_idx, v.size, v.dts_delta, v.cts_offset FROM tseg s JOIN tv v ON v.archive_id = s.archive_id AND v.sample_idx >= s.video_sample_start AND v.sample_idx < s.video_sample_start + s.video_sample_count
  UNION ALL SELECT s.archive_id, s.segment_idx, 2, a.sample_idx, a.size, a.dts_delta, 0 FROM tseg s JOIN audio a ON a.archive_id = s.archive_id AND a.sample_idx >= s.audio_sample_start AND a.sample_idx < s.audio_sample_start + s.audio_sample_count),
psum AS (SELECT archive_id, segment_idx, count(*) FILTER (WHERE r = 1) AS nv, count(*) FILTER (WHERE r = 2) AS na, sum(size) AS bytes, sum(size) FILTER (WHERE r = 1) AS vb, sum(dts_delta) FILTER (WHERE r = 1) AS ticks FROM part GROUP BY 1, 2),
tlay AS (SELECT p.*, has_ctts, t, CAST(nv * (CASE WHEN has_ctts THEN 12 ELSE 8 END) AS BIGINT) AS rv, CAST(8 * na AS BIGINT) AS ra FROM psum p JOIN flags USING (archive_id))"""
HEX_SQL = """hexed AS (SELECT archive_id, segment_idx,
   string_agg(CASE WHEN r = 2 THEN '' WHEN has_ctts THEN printf('%08X%08X%08X', dts_delta, size, (cts_offset + 4294967296) % 4294967296) ELSE printf('%08X%08X', dts_delta, size) END, '' ORDER BY r, sample_idx) AS vrows,
   string_agg(CASE WHEN r = 1 THEN '' ELSE printf('%08X%08X', dts_delta, size) END, '' ORDER BY r, sample_idx) AS arows, string_agg(repeat(printf('%02X', 65 + sample_idx % 26), size), '' ORDER BY r, sample_idx) AS payload
  FROM part JOIN flags USING (archive_id) GROUP BY 1, 2),
made AS (SELECT l.archive_id, l.segment_idx,
   '00000018737479706D736468000000006D736468636D6663' || printf('%08X', 156 + rv + ra) || '6D6F6F66' || '000000106D66686400000000' || printf('%08X', l.segment_idx + 1)
   || printf('%08X', 68 + rv) || '74726166' || '0000001074666864' || '0002000000000001' || '0000001474666474' || '01000000' || printf('%016X', video_base_dts)
   || printf('%08X', 24 + rv) || '7472756E' || (CASE WHEN has_ctts THEN '01000B05' ELSE '00000305' END) || printf('%08X%08X', nv, 164 + rv + ra) || '02000000' || vrows
   || printf('%08X', 64 + ra) || '74726166' || '0000001074666864' || '0002000000000002' || '0000001474666474' || '01000000' || printf('%016X', audio_sample_start * 1036800000)
   || printf('%08X', 20 + ra) || '7472756E' || '00000301' || printf('%08X%08X', na, CAST(164 + rv + ra + vb AS BIGINT)) || arows || printf('%08X', CAST(8 + bytes AS BIGINT)) || '6D646174' || payload AS hex
  FROM tlay l JOIN hexed USING (archive_id, segment_idx) JOIN tseg s ON s.archive_id = l.archive_id AND s.segment_idx = l.segment_idx)"""


#: Divisors of the rows' microseconds, the largest first.
SCALES = [t for t in range(adapters.TIMESCALE, 0, -1) if adapters.TIMESCALE % t == 0]


def _ticks(us):
    """(timescale, deltas) of an archive's video out of its deltas in microseconds.

    A delta has 32 bits in the format, so the timescale is the largest divisor of the rows' microseconds in which each fits; decode
    times are rounded down to its ticks, so they do not drift.
    """
    most = int(us.max(initial=0))
    timescale = next((t for t in SCALES if most * t // adapters.TIMESCALE < U32_MAX), 1)
    at = [x * timescale // adapters.TIMESCALE for x in itertools.accumulate(us.tolist(), initial=0)]
    return timescale, [b - a for a, b in itertools.pairwise(at)]


def _containers(spark, sf_dir):
    """(archive_id, path): each user's archive, packed in the shared folder by the task that has the user's samples.

    Payloads are runs of one byte, so an archive is kept as its head and its runs: on the disk it takes some bytes a sample, whatever their sizes.
    """
    from .functions import synthetic
    from .plans.staging import runs_of, shared_folder
    from .sources import files

    samples, _ = adapters.media(spark, sf_dir)
    folder = shared_folder(spark, "containers")

    def make(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        with files.pack_writer(folder) as add:
            for table in runs_of(batches, "archive_id"):
                name = table.column("archive_id")[0].as_py()
                video, audio = (table.filter(pc.equal(table.column("track"), t)) for t in ("video", "audio"))
                timescale, deltas = _ticks(video.column("dts_delta").to_numpy())
                sync = pc.indices_nonzero(video.column("is_sync")).to_pylist()
                record = files.packed(*synthetic.parts(
                    {"timescale": timescale, "deltas": deltas, "sizes": video.column("size").to_pylist(), "sync": sync, "cts": video.column("cts_offset").to_pylist()},
                    {"timescale": adapters.AUDIO_TIMESCALE, "deltas": audio.column("dts_delta").to_pylist(), "sizes": audio.column("size").to_pylist()},
                ))
                yield pa.RecordBatch.from_pydict({"archive_id": [name], "path": [add(f"{name}.mp4", record)]})

    stream = dealt(samples, "archive_id").sortWithinPartitions("archive_id", "track", "sample_idx")
    return staged(stream.mapInArrow(make, "archive_id string, path string"), "container-paths")


def _archive_rows(containers):
    from .sources import files
    from .sources.mp4 import ARCHIVES, archive_row

    def parse(frames):
        import pandas as pd

        for frame in frames:
            for path in frame["path"]:  # one at a time: an archive's tables are large
                with files.opened(path) as (read, length):
                    row = archive_row(read, length, path)
                yield pd.DataFrame([row], columns=["archive_id", "path", "source_len", "variant", "detail", "video", "audio"])

    # rows are paths, so their size says nothing of the work
    return containers.repartition("archive_id").mapInPandas(parse, ARCHIVES)


@query(
    BYTES
    + """, one AS (SELECT * FROM file),
track AS (SELECT archive_id, 'v' AS k, CAST(28 AS BIGINT) AS pos, v_stbl AS stbl, n_video AS n, n_sync FROM one UNION ALL SELECT archive_id, 'a', CAST(28 + 8 + 92 + 8 + 32 + 33 + 8 + v_stbl AS BIGINT), a_stbl, n_audio, 0 FROM one),
kid AS (SELECT archive_id, k, n, n_sync, pos + 8 + 92 + 8 + 32 + 33 + 8 AS pos, unnest(['stsd', 'stts', 'stsc', 'stsz', 'co64', 'stss', 'ctts']) AS box_type, unnest(range(7)) AS i FROM track),
sized AS (SELECT *, CAST(CASE box_type WHEN 'stsd' THEN CASE k WHEN 'v' THEN 102 ELSE 52 END WHEN 'stts' THEN 16 + 8 * n WHEN 'stsc' THEN 28 WHEN 'stsz' THEN 20 + 4 * n WHEN 'co64' THEN 24 WHEN 'stss' THEN 16 + 4 * n_sync ELSE 16 + 8 * n END AS BIGINT) AS size
  FROM kid WHERE k = 'v' OR i < 5),
leaf AS (SELECT archive_id, '/moov/trak/mdia/minf/stbl' AS parent_path, box_type, CAST(pos + 8 + coalesce(sum(size) OVER (PARTITION BY archive_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, size, 5 AS depth FROM sized),
upper_ AS (SELECT archive_id, pos, stbl, unnest(['trak', 'tkhd', 'mdia', 'mdhd', 'hdlr', 'minf', 'stbl']) AS box_type FROM track),
every AS (
  SELECT * FROM leaf
  UNION ALL SELECT archive_id, CASE box_type WHEN 'trak' THEN '/moov' WHEN 'tkhd' THEN '/moov/trak' WHEN 'mdia' THEN '/moov/trak' WHEN 'stbl' THEN '/moov/trak/mdia/minf' ELSE '/moov/trak/mdia' END, box_type,
    pos + CASE box_type WHEN 'trak' THEN 0 WHEN 'tkhd' THEN 8 WHEN 'mdia' THEN 100 WHEN 'mdhd' THEN 108 WHEN 'hdlr' THEN 140 WHEN 'minf' THEN 173 ELSE 181 END,
    CAST(CASE box_type WHEN 'trak' THEN 181 + stbl WHEN 'tkhd' THEN 92 WHEN 'mdia' THEN 81 + stbl WHEN 'mdhd' THEN 32 WHEN 'hdlr' THEN 33 WHEN 'minf' THEN 8 + stbl ELSE stbl END AS BIGINT),
    CASE box_type WHEN 'trak' THEN 1 WHEN 'tkhd' THEN 2 WHEN 'mdia' THEN 2 WHEN 'stbl' THEN 4 ELSE 3 END FROM upper_
  UNION ALL SELECT archive_id, '', 'ftyp', 0, 20, 0 FROM one UNION ALL SELECT archive_id, '', 'moov', 20, payload_at - 28, 0 FROM one UNION ALL SELECT archive_id, '', 'mdat', payload_at - 8, source_len - payload_at + 8, 0 FROM one)
SELECT archive_id, parent_path, box_type, CAST(start AS BIGINT) AS start, 8 AS header_size, CAST(size AS BIGINT) AS declared_size, CAST(start + 8 AS BIGINT) AS payload_offset, depth FROM every"""
)
def box_scan(spark, sf_dir):
    from .schema import BOXES
    from .sources import demux, files

    def scan(frames):
        import pandas as pd

        for frame in frames:
            for name, path in zip(frame["archive_id"], frame["path"], strict=True):
                with files.opened(path) as (read, length):
                    rows = [(name, parent, b.kind, b.start, b.header, b.size, b.body, depth) for parent, depth, b in demux.tree(read, length)]
                yield pd.DataFrame(rows, columns=["archive_id", "parent_path", "box_type", "start", "header_size", "declared_size", "payload_offset", "depth"])

    return _containers(spark, sf_dir).repartition("archive_id").mapInPandas(scan, BOXES)


def _build(spark, sf_dir):
    from .plans.build import Build

    return Build(_archive_rows(_containers(spark, sf_dir)), SECONDS)


@query(
    BYTES
    + f""", {PARTS_SQL},
largest AS (SELECT archive_id, max(188 + rv + ra + bytes) AS b, count(*) AS n, max(ticks) AS most FROM tlay GROUP BY 1),
entries AS (SELECT archive_id, string_agg('#EXTINF:' || printf('%.6f', CAST(ticks AS DOUBLE) / t) || ',' || chr(10) || printf('seg_%04d.m4s', segment_idx + 1) || chr(10), '' ORDER BY segment_idx) AS body FROM tlay GROUP BY 1)
SELECT archive_id, CAST(NULL AS VARCHAR) AS variant, CAST(b AS BIGINT) AS max_segment_size, source_len, true AS hash_matches, CAST(n_video AS INTEGER) AS n_video, CAST(n_audio AS INTEGER) AS n_audio, CAST(n AS INTEGER) AS n_segments,
 CAST(v_bytes AS BIGINT) AS video_bytes, CAST(a_bytes AS BIGINT) AS audio_bytes, CAST(v_ticks AS BIGINT) AS video_ticks, CAST(n_sync AS BIGINT) AS n_sync, payload_at AS first_video_offset, CAST(payload_at + v_bytes AS BIGINT) AS first_audio_offset,
 '#EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-INDEPENDENT-SEGMENTS' || chr(10) || '#EXT-X-TARGETDURATION:' || CAST((most + t - 1) // t AS BIGINT) || chr(10) || '#EXT-X-PLAYLIST-TYPE:VOD' || chr(10)
 || '#EXT-X-MAP:URI="init.mp4"' || chr(10) || body || '#EXT-X-ENDLIST' || chr(10) AS playlist
FROM file JOIN largest USING (archive_id) JOIN entries USING (archive_id)"""
)
def idx_roundtrip(spark, sf_dir):
    """Index files made, opened again, and held to their archives: what the tables add up to, the hash and the playlist body."""
    from .functions.blake3 import blake3_bytes
    from .sources import files
    from .sources.mp4 import INDEX, index_row

    def open_all(frames):
        import pandas as pd

        names = [f.split(" ")[0] for f in ("archive_id", "variant", "detail", "max_segment_size", "source_len", "source_hash", "init", "playlist", "video_samples", "audio_samples", "segments", "video", "audio")]
        for frame in frames:
            for r in frame.itertuples(index=False):  # one at a time: an index is large
                row = pd.DataFrame([index_row(r.index_, f"{r.archive_id}.idx")], columns=names)
                with files.opened(r.path) as (read, length):
                    yield row.assign(hash_matches=row["source_hash"][0] == blake3_bytes(read(0, length)))

    build = _build(spark, sf_dir)
    made = build.indexes().withColumnRenamed("index", "index_").join(build.fine.select("archive_id", "path"), "archive_id")
    rows = made.mapInPandas(open_all, f"{INDEX}, hash_matches boolean")
    total = lambda t, c: F.aggregate(f"{t}_samples", F.lit(0).cast("long"), lambda a, x: a + x[c])
    return rows.select(
        "archive_id", "variant", "max_segment_size", "source_len", "hash_matches", F.size("video_samples").alias("n_video"), F.size("audio_samples").alias("n_audio"), F.size("segments").alias("n_segments"),
        total("video", "size").alias("video_bytes"), total("audio", "size").alias("audio_bytes"), total("video", "dts_delta").alias("video_ticks"), F.size(F.filter("video_samples", lambda x: x["is_sync"])).cast("long").alias("n_sync"),
        F.col("video_samples")[0]["offset"].alias("first_video_offset"), F.col("audio_samples")[0]["offset"].alias("first_audio_offset"), lookup.playlist_body(F.col("playlist"), F.lit(None).cast("string")).alias("playlist"),
    )


@query(
    BYTES
    + """, bytes AS (SELECT archive_id, '00000018' || '66747970' || '636D6663' || '00000000' || '69736F36636D6663' || '00000418' || '6D6F6F76'
 || '00000078' || '6D766864' || '01000000' || repeat('00', 16) || '000003E8' || repeat('00', 8) || '00010000' || '0100' || repeat('00', 10) || matrix || repeat('00', 24) || '00000003'
 || '000001C3' || '7472616B' || '00000068' || '746B6864' || '01000007' || repeat('00', 16) || '00000001' || repeat('00', 28) || matrix || '07800000' || '04380000'
 || '00000153' || '6D646961' || '0000002C' || '6D646864' || '01000000' || repeat('00', 16) || printf('%08X', t) || repeat('00', 8) || '55C40000'
 || '0000002D' || '68646C72' || repeat('00', 8) || '76696465' || repeat('00', 12) || '566964656F48616E646C6572' || '00'
 || '000000F2' || '6D696E66' || '00000014' || '766D6864' || '00000001' || repeat('00', 8) || dinf || '000000B2' || '7374626C' || '00000066' || '73747364' || '00000000' || '00000001' || '00000056' || '61766331' || repeat('00', 78) || tables
 || '0000018D' || '7472616B' || '00000068' || '746B6864' || '01000007' || repeat('00', 16) || '00000002' || repeat('00', 24) || '01000000' || matrix || repeat('00', 8)
 || '0000011D' || '6D646961' || '0000002C' || '6D646864' || '01000000' || repeat('00', 16) || '0000BB80' || repeat('00', 8) || '55C40000'
 || '0000002D' || '68646C72' || repeat('00', 8) || '736F756E' || repeat('00', 12) || '536F756E6448616E646C6572' || '00'
 || '000000BC' || '6D696E66' || '00000010' || '736D6864' || repeat('00', 8) || dinf || '00000080' || '7374626C' || '00000034' || '73747364' || '00000000' || '00000001' || '00000024' || '6D703461' || repeat('00', 6) || '0001' || repeat('00', 8)
 || '00020010' || '00000000' || 'BB800000' || tables
 || '00000048' || '6D766578' || '00000020' || '74726578' || '00000000' || '00000001' || '00000001' || repeat('00', 8) || '01010000' || '00000020' || '74726578' || '00000000' || '00000002' || '00000001' || repeat('00', 8) || '02000000' AS hex
 FROM flags, (SELECT '00010000' || repeat('00', 12) || '00010000' || repeat('00', 12) || '40000000' AS matrix, '0000002464696E66' || '0000001C64726566' || '00000000' || '00000001' || '0000000C75726C20' || '00000001' AS dinf,
  '0000001073747473' || repeat('00', 8) || '0000001073747363' || repeat('00', 8) || '000000147374737A' || repeat('00', 12) || '000000107374636F' || repeat('00', 8) AS tables))
SELECT archive_id, CAST(length(hex) // 2 AS INTEGER) AS n_bytes, sha256(unhex(hex)) AS sha256 FROM bytes"""
)
def init_bytes(spark, sf_dir):
    from .functions.boxes import init_segment

    def make(frames):
        import pandas as pd

        for frame in frames:
            yield pd.DataFrame([(r.archive_id, init_segment(r.video, r.audio)) for r in frame.itertuples(index=False)], columns=["archive_id", "init"])

    rows = _archive_rows(_containers(spark, sf_dir)).filter("variant is null")
    meta = lambda t: F.struct(*[F.col(f"{t}.{c}").alias(c) for c in ("timescale", "width", "height", "sample_entry", "elst")]).alias(t)
    return rows.select("archive_id", meta("video"), meta("audio")).mapInPandas(make, "archive_id string, init binary").select("archive_id", F.length("init").alias("n_bytes"), F.sha2("init", 256).alias("sha256"))


@query(BYTES + f", {PARTS_SQL}, {HEX_SQL} SELECT archive_id, segment_idx, CAST(length(hex) // 2 AS INTEGER) AS n_bytes, sha256(unhex(hex)) AS sha256 FROM made")
def segment_bytes_blob(spark, sf_dir):
    """Every segment of each archive, as bytes."""
    build = _build(spark, sf_dir)
    return build.media_segments(build.segments).select("archive_id", "segment_idx", F.length("bytes").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


@query(BYTES + f", {PARTS_SQL}, {HEX_SQL}, {REQUEST_SQL.replace('FROM seg GROUP', 'FROM tseg GROUP')} SELECT request_id, res.segment_idx, status, sha256(unhex(hex)) AS sha256 FROM res JOIN req USING (request_id) LEFT JOIN made ON status = 200 AND made.archive_id = u AND made.segment_idx = res.segment_idx WHERE kind = 'segment'")
def segment_requests(spark, sf_dir):
    """Requests for segments, with the bytes of those that are answered; each segment is made once."""
    build = _build(spark, sf_dir)
    found = staged(lookup.resolve(adapters.requests(spark, sf_dir), _catalogue(build.segments)).filter("kind = 'segment'"), "resolved")
    fine = found.filter("status = 200").select(F.col("id").alias("archive_id"), "segment_idx")
    made = build.media_segments(fine).select(F.col("archive_id").alias("id"), "segment_idx", F.sha2("bytes", 256).alias("sha256"), F.lit(200).alias("status"))
    return found.join(made, ["id", "segment_idx", "status"], "left").select("request_id", "segment_idx", "status", "sha256")


def _literal(text):
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


def _cases(spark, sf_dir, cases):
    """(archive_id, path): an archive of each case, by part."""
    from .plans.staging import shared_folder
    from .sources import files

    folder, n = shared_folder(spark, "cases"), len(cases)

    def make(frames):
        import pandas as pd

        for frame in frames:
            rows = [(str(p), files.write_part(folder, f"{p}.mp4", rules.broken(cases, p % n))) for p in frame["p_partkey"]]
            files.put_in_place(folder, [part for _, part in rows])
            yield pd.DataFrame([(p, f"{folder}/{p}.mp4") for p, _ in rows], columns=["archive_id", "path"])

    return staged(adapters.read(spark, sf_dir, "part").select("p_partkey").mapInPandas(make, "archive_id string, path string"), "case-paths")


@query(
    f"SELECT CAST(p_partkey AS VARCHAR) AS archive_id, [{', '.join(_literal(v) for _, _, v in rules.GATES)}][p_partkey % {len(rules.GATES)} + 1] AS variant, CASE WHEN [{', '.join(_literal(v) for _, _, v in rules.GATES)}][p_partkey % {len(rules.GATES)} + 1] IS NULL"
    f" THEN CASE p_partkey % {len(rules.GATES)} WHEN {[n for n, _, _ in rules.GATES].index('a later mdhd')} THEN 77 ELSE 30 END END AS timescale FROM part"
)
def container_gates(spark, sf_dir):
    """The refusal of an archive for each broken rule, and the timescale (the last of several) of the accepted ones."""
    return _archive_rows(_cases(spark, sf_dir, rules.GATES)).select("archive_id", "variant", "video.timescale")


@query(
    f"SELECT archive_id, 'SampleTableInconsistent' AS variant, detail FROM (SELECT CAST(p_partkey AS VARCHAR) AS archive_id, [{', '.join(_literal(v) for _, _, v in rules.TABLES)}][p_partkey % {len(rules.TABLES)} + 1] AS detail FROM part) WHERE detail IS NOT NULL"
)
def table_rules(spark, sf_dir):
    """The first broken rule of each archive's sample tables."""
    from .plans.build import table_errors

    return table_errors(staged(_archive_rows(_cases(spark, sf_dir, rules.TABLES)), "case-archives"))


@query(
    """WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS archive_id, c_custkey % 3 AS n_video, c_custkey % 5 AS n_audio, c_custkey % 7 <> 0 AS first_sync, (c_custkey % 11) * 1000 AS v, (c_custkey % 13) * 1000 AS a FROM customer)
SELECT archive_id, CASE WHEN n_video = 0 THEN 'video track has no samples' WHEN n_audio = 0 THEN 'audio track has no samples' WHEN NOT first_sync THEN 'the video does not open with a sync sample' WHEN v = 0 OR a = 0 THEN 'timescale is zero' END AS detail FROM c"""
)
def segment_preconditions(spark, sf_dir):
    k = F.col("c_custkey")
    rows = adapters.read(spark, sf_dir, "customer").select(k.cast("string").alias("archive_id"), (k % 3).alias("n_video"), (k % 5).alias("n_audio"), (k % 7 != 0).alias("first_sync"), (k % 11 * 1000).alias("video_timescale"), (k % 13 * 1000).alias("audio_timescale"))
    return segmenter.precondition_error(rows, 6.0)


@query(
    """SELECT event_id, printf('%08X', event_id * 2654435761 % 4294967296) AS written, event_id * 2654435761 % 4294967296 AS unsigned_, CAST(CASE WHEN event_id * 2654435761 % 4294967296 >= 2147483648 THEN event_id * 2654435761 % 4294967296 - 4294967296 ELSE event_id * 2654435761 % 4294967296 END AS INTEGER) AS signed_,
 printf('%016X', event_id * 1000003) AS wide, printf('%08X', 4294967296 - 1 - event_id) AS negative, event_id * 1000 // 65536 AS decoded, least(event_id * 17 * 65536, 4294967295) AS encoded, event_id & 4 <> 0 AS flag, (8 - event_id % 8) % 8 AS pad,
 'ab' || chr(CAST(160 + event_id % 90 AS INTEGER)) || ' ' AS code FROM events"""
)
def byte_fields(spark, sf_dir):
    """Fields written, read back and decoded."""
    e = adapters.read(spark, sf_dir, "events").select("event_id")
    n = F.col("event_id")
    word = n * F.lit(2654435761) % F.lit(4294967296)
    code = F.concat(F.unhex(F.lit("6162")), scalar.be_write(F.lit(160).cast("long") + n % 90, 1), F.unhex(F.lit("20")))
    return e.select(
        "event_id", F.hex(scalar.be_write(word, 4)).alias("written"), scalar.be_read(scalar.be_write(word, 4)).alias("unsigned_"), scalar.be_read_signed32(scalar.be_write(word, 4)).alias("signed_"), F.hex(scalar.be_write(n * 1000003, 8)).alias("wide"),
        F.hex(scalar.be_write(-1 - n, 4)).alias("negative"), scalar.fixed16_decode(n * 1000).alias("decoded"), scalar.fixed16_encode(n * 17).alias("encoded"), scalar.flag_set(n, 2).alias("flag"), scalar.pad8(n).alias("pad"), scalar.fourcc(code).alias("code"),
    )


@query(
    """SELECT event_type AS host, event_id AS seq, CAST(user_id % 3 AS VARCHAR) AS id, coalesce(lag(user_id % 3) OVER (PARTITION BY event_type ORDER BY event_id) = user_id % 3, false) AS hit FROM events"""
)
def lru_without_room(spark, sf_dir):
    """A capacity of 0 counts as 1."""
    trace = adapters.read(spark, sf_dir, "events").select(F.col("event_type").alias("host"), F.col("event_id").alias("seq"), (F.col("user_id") % 3).cast("string").alias("id"))
    return capacity.replay_lru(trace, 0)


@query(ORACLES["playlist_text"].replace("SELECT n.archive_id, '#EXTM3U'", "SELECT n.archive_id, CAST(n.archive_id AS BIGINT) % 2 = 0 AS stored, '#EXTM3U'").replace("AS playlist\n", "AS body\n"))
def playlist_served(spark, sf_dir):
    """The stored playlist with its padding to eight bytes taken off; every other archive has none, so it is computed."""
    _, scales, sums = _sums(spark, sf_dir)
    rows = layout.playlist_text(sums, scales).withColumn("stored", F.col("archive_id").cast("long") % 2 == 0)
    kept = F.when(F.col("stored"), F.concat(F.col("playlist"), F.repeat(F.lit("\n"), scalar.pad8(F.octet_length("playlist")).cast("int"))))
    return rows.select("archive_id", "stored", lookup.playlist_body(kept, F.when(~F.col("stored"), F.col("playlist"))).alias("body"))


@query()
def digest_blake3(spark, sf_dir):
    """The content hash of every page."""
    import pandas as pd

    from .functions.blake3 import blake3_bytes

    def digest(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else blake3_bytes(h.encode()).hex())

    digest.__annotations__ = {"html": pd.Series, "return": pd.Series}
    return adapters.read(spark, sf_dir, "pages").select("page_id", F.pandas_udf(digest, "string")("html").alias("blake3"))


@query(
    """WITH RECURSIVE t AS (SELECT event_type AS host, event_id AS seq, epoch_us(ts) / 1e6 AS arrival, 300.0 + event_id % 2000 AS service, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) / 1e6, event_id) AS n FROM events),
r AS (SELECT host, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 0.0::DOUBLE AS arrival, 0.0::DOUBLE AS service, CAST(NULL AS DOUBLE) AS start, 0.0::DOUBLE AS wait, 0 AS status, ['-inf'::DOUBLE, '-inf'::DOUBLE, '-inf'::DOUBLE, '-inf'::DOUBLE] AS free FROM (SELECT DISTINCT host FROM t)
 UNION ALL SELECT t.host, t.n, t.seq, t.arrival, t.service, CASE WHEN b - t.arrival <= 600 THEN b END, CASE WHEN b - t.arrival <= 600 THEN b - t.arrival ELSE 600 END, CASE WHEN b - t.arrival <= 600 THEN 200 ELSE 503 END,
  CASE WHEN b - t.arrival <= 600 THEN list_sort(list_append(r.free[2:], b + t.service)) ELSE r.free END
 FROM r JOIN t ON t.host = r.host AND t.n = r.n + 1, LATERAL (SELECT greatest(t.arrival, r.free[1]) AS b))
SELECT host, seq, arrival, service, start, wait, status FROM r WHERE n > 0"""
)
def admission_replay(spark, sf_dir):
    """Event arrivals through an admission queue of four permits per event type."""
    e = adapters.read(spark, sf_dir, "events")
    trace = e.select(F.col("event_type").alias("host"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("arrival"), (F.lit(300.0) + F.col("event_id") % 2000).alias("service"))
    return capacity.replay_admission(trace, 4, 600.0)
