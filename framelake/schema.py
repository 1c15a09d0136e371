"""Fixed row schemas.  Unsigned 32-bit values are BIGINT; unsigned 64-bit ones are BIGINT with a guard where they are read."""

SAMPLES = "archive_id string, track string, sample_idx long, offset long, size long, dts_delta long, cts_offset int, is_sync boolean"
TRACKS = "archive_id string, track string, timescale long, fourcc string, width long, height long, sample_rate long, channel_count int, sample_entry binary, elst binary, stss_absent boolean"
SEGMENTS = "archive_id string, segment_idx long, video_sample_start long, video_sample_count long, audio_sample_start long, audio_sample_count long, video_base_dts long, audio_base_dts long"
BOXES = "archive_id string, parent_path string, box_type string, start long, header_size int, declared_size long, payload_offset long, depth int"
ERRORS = "archive_id string, variant string, detail string"

U32_MAX = 4_294_967_295
I32_MAX = 2_147_483_647
I64_MAX = 9_223_372_036_854_775_807
