"""End-to-end jobs over all videos at once. Stage tables are written where they are reused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.operators import chunks, events, features, frames, labels, masks, repair, windows
from trackspark.operators.joins import check_empty, key_difference
from trackspark.session import cut_lineage
from trackspark.sources import writers


def scan(detections: DataFrame, videos: DataFrame, *, fps: float = 25.0, **thresholds) -> dict[str, DataFrame]:
    """Frame metrics, occlusion periods, transition frames and separation windows."""
    metrics = cut_lineage(frames.detection_frames(detections, **thresholds), "frames")
    periods = events.occlusion_periods(metrics, window_frames=int(fps))
    edges = periods.select("video_id", F.explode(F.array("start_frame", "end_frame")).alias("frame_idx"))
    return {
        "frames": metrics,
        "occlusion_periods": periods,
        "transition_frames": edges.distinct().orderBy("video_id", "frame_idx"),
        "separation_windows": events.separation_windows(metrics, min_frames=max(1, int(fps))),
        "chunks": chunks.adaptive_chunks(metrics, videos),
    }


def find_issues(tracks: DataFrame, fps: DataFrame, birds: DataFrame) -> dict[str, DataFrame]:
    """Detected issues and the correction template a person fills in."""
    over = masks.mask_overlaps(tracks, threshold=0.7)
    over = over.join(fps.select("video_id", F.coalesce("fps", F.lit(25.0)).alias("fps")), "video_id", "left")
    issues = events.tracking_issues(
        events.overlap_periods(over.fillna(25.0, ["fps"])),
        events.id_transitions(tracks, fps),
        events.low_score_periods(tracks, fps),
    )
    issues = cut_lineage(issues, "issues")
    return {"issues": issues, "template": repair.action_template(issues, tracks, birds, fps)}


def build_dataset(
    tracks: DataFrame, sheets: DataFrame, actions: DataFrame, fps: DataFrame, *, min_coverage: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Repair -> align labels -> assign windows -> drop badly covered windows -> check keys."""
    lab = labels.resolve_dual_groups(labels.long_labels(sheets))
    t, lab = repair.process_tracks(tracks, lab, actions, fps)
    t = cut_lineage(t, "repaired")
    lab = cut_lineage(windows.align_labels(t, lab, fps), "labels")
    t, lab = windows.assign_windows(t, lab, fps)
    t, lab = cut_lineage(t, "windowed"), cut_lineage(lab, "numbered")
    t, lab = windows.filter_incomplete(t, lab, fps, min_coverage=min_coverage)
    t, lab = cut_lineage(t, "tracks"), cut_lineage(lab, "labels")
    check_empty(key_difference(t, lab, windows.WINDOW), "windows that only tracks or only labels have")
    return writers.lead_columns(t), lab


def extract_features(tracks: DataFrame) -> dict[str, DataFrame]:
    """Per-frame features, window summaries and sequences from mask tracks with windows."""
    per_frame = cut_lineage(features.frame_features(masks.spatial_features(tracks)), "features")
    return {
        "features_all": per_frame,
        "features_windowed": features.summarise(per_frame),
        "sequences": features.window_sequences(per_frame),
    }
