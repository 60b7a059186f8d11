"""Explicit schemas of the domain tables."""

from __future__ import annotations

TRACKING_RAW = (
    "frame_idx int, object_id int, bbox array<double>, counts string, size array<int>, scores double, "
    "tracker_score double, chunk_idx int, model_type string, is_chunk_start boolean"
)
DETECTIONS = (
    "frame int, track_id int, x1 double, y1 double, x2 double, y2 double, cx_norm double, "
    "cy_norm double, confidence double"
)
ACTIONS = (
    "type string, cause string, frame int, `from` int, `to` int, id int, protocol_id string, "
    "description string, tracking_id int, _time string"
)
CHUNK_INFO = (
    "chunks array<struct<chunk_idx: int, frame_range: array<int>, model_type: string, "
    "prompt_points: map<string, array<array<double>>>, num_objects_tracked: int, "
    "source_frame_idx: int, fallback_reason: string, grounding_used: boolean, "
    "grounding_source_frame_idx: int, grounding_num_objects: int, grounding_fallback_reason: string, "
    "timing: struct<elapsed_seconds: double, avg_seconds_per_frame: double, fps: double, num_frames: int>>>"
)
ISSUES = (
    "type string, start int, `end` int, start_time double, end_time double, ids array<int>, id int, "
    "ids_before array<int>, ids_after array<int>, lost array<int>, gained array<int>, "
    "low_score_rows int, total_rows int, min_score double"
)
MOT = "frame int, id int, x double, y double, w double, h double, conf double, _a int, _b int, _c int"
ANNOTATION = (
    "tracks array<struct<shapes: array<struct<frame: int, type: string, outside: boolean, points: array<double>>>>>"
)
MANIFEST = (
    "video_id string, cage string, `group` string, day int, path string, scan_dir string, "
    "selected string, notes string, difficulty int, rank_in_cage int"
)
KEYFRAMES = "video_id string, frame_idx int, source string"
SCAN_SUMMARY = "total_frames int, video_duration_seconds double, fps double, num_occlusion_periods int"
NESTED_FRAMES = (
    "frame_idx int, object_ids array<int>, boxes array<array<double>>, scores array<double>, "
    "obj_id_to_tracker_score map<string, double>, "
    "detections array<struct<id: int, bbox: array<double>, score: double, tracker_score: double>>, "
    "instances array<struct<id: int, bbox: array<double>, score: double, tracker_score: double>>"
)
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
