"""Table schemas of the media-feature lakehouse (DDL strings)."""

STREAM = (
    "struct<index:string,codec:string,codec_type:string,pix_fmt:string,w:int,h:int,"
    "sample_rate:int,channel_layout:string,bit_rate:bigint,fps:float,channels:int,hdr:string>"
)

MEDIA = (
    "file_id bigint, path string, folder string, size bigint, created timestamp, modified timestamp, "
    f"flags int, is_image boolean, duration_s double, streams array<{STREAM}>, content_key string"
)
FRAMES = "file_id bigint, pos int, sec double, gray binary, phash bigint, dark boolean"
AUDIO_FP = "file_id bigint, words array<int>"
EMBEDDINGS = "file_id bigint, pos int, vec array<tinyint>"
DENSE_FRAMES = "file_id bigint, slot int, interval_s float, vec array<tinyint>"
LISTING = (
    "path string, size bigint, created timestamp, modified timestamp, dev bigint, inode bigint, content_key string"
)
NOT_A_MATCH = "set_id bigint, path string"
DUP_ITEMS = (
    "group_id string, path string, folder string, size bigint, similarity float, duration_s double, w int, h int, "
    "frame_size_int int, format string, audio_format string, audio_channel string, audio_sample_rate int, "
    "audio_kbps decimal(18,0), kbps decimal(18,0), fps float, hdr string, created timestamp, is_image boolean, "
    "flags smallint, clip_offset_s double, checked boolean"
)
LOG_EVENTS = "ts timestamp, severity int, message string, is_session_start boolean"
ATTEMPTS = "ts timestamp, phase string, path string, event string"
