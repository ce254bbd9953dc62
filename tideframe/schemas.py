"""Schemas of all entities."""

from __future__ import annotations

METADATA = "struct<duration:double,fps:double,width:int,height:int,codec:string>"
OCCURRENCE = "struct<recording_id:string,start:double,`end`:double,start_tc:string,end_tc:string,representative_timestamp:double,confidence:double>"

RECORDINGS = f"id string, filename string, path string, added_at string, status string, metadata {METADATA}, transcript_id string, error string"
TRANSCRIPTS = "id string, filename string, path string, format string, bytes bigint, recording_id string"
FRAMES = "recording_id string, idx int, ts double, path string"
SHIFTS = "recording_id string, idx int, dx double, dy double, response double"
SEGMENTS = "recording_id string, seg_no int, start_idx int, end_idx int, start_time double, end_time double, rep_idx int, centroid array<double>, confidence double"
STATES = f"id string, label string, representative_screenshot string, kind string, stitched_screenshot string, occurrences array<{OCCURRENCE}>"
SCREENSHOTS = "id string, state_id string, path string, type string, recording_id string, timestamp double, width int, height int"
TRANSITIONS = "id string, recording_id string, from_state string, to_state string, at double, at_tc string, kind string, confidence double"
CONFIG = (
    "struct<sample_fps:double,embedder:string,cut_distance:double,sustain_frames:int,min_state_seconds:double,merge_distance:double,scroll_min_shift_px:double,"
    "scroll_max_horizontal_px:double,scroll_min_response:double,scroll_min_run:int,scroll_min_embedding_change:double,stitch_max_height_px:int>"
)
MANIFEST = (
    f"project string, schema_version string, created_at string, updated_at string, config {CONFIG}, recordings array<struct<{RECORDINGS.replace(' ', ':').replace(',:', ',')}>>,"
    f" transcripts array<struct<{TRANSCRIPTS.replace(' ', ':').replace(',:', ',')}>>, states array<struct<{STATES.replace(' ', ':').replace(',:', ',')}>>,"
    f" screenshots array<struct<{SCREENSHOTS.replace(' ', ':').replace(',:', ',')}>>, transitions array<struct<{TRANSITIONS.replace(' ', ':').replace(',:', ',')}>>"
)
SCHEMA_VERSION = "1.0"
