"""Schemas of the rows that flow: frames, observations, triggers, flow rows and trace records.

Time is int64 nanoseconds everywhere; Spark timestamps, which hold microseconds, are derived only for watermarks.
"""

from __future__ import annotations

TRIGGER = "struct<fire: boolean, score: double, reason: string, label: string, event_ns: bigint, clip_start_ns: bigint, clip_end_ns: bigint>"
OBS = f"struct<source: string, frame_id: bigint, t_ns: bigint, signals: map<string,double>, data: string, metadata: map<string,string>, timing: map<string,double>, trigger: {TRIGGER}>"
FRAME = "stream_id string, frame_id bigint, t_ns bigint, seq bigint"
FLOW = f"{FRAME}, path_id string, timestamp_ns bigint, observations array<{OBS}>, results array<{OBS}>, metadata map<string,string>"
#: Columns that every flow row has; any others (a frame's payload) travel with it.
FLOW_COLUMNS = ("stream_id", "frame_id", "t_ns", "seq", "path_id", "timestamp_ns", "observations", "results", "metadata")
TRIGGERS = "stream_id string, frame_id bigint, event_ns bigint, clip_start_ns bigint, clip_end_ns bigint, label string, score double, reason string, source string"
DETECTION = "struct<bbox: struct<x: int, y: int, w: int, h: int>, confidence: double, class_id: int, class_name: string, metadata: map<string,string>>"
WORKER_RESULT = f"struct<observation: {OBS}, error: string, timing_ms: double>"
TRACE = (
    "record_type string, timestamp_ns bigint, min_level int, frame_id bigint, component string, processing_ms double, queue_depth int, threshold_ms double, is_slow boolean, "
    "dropped_frame_ids array<bigint>, reason string, expected_ns bigint, actual_ns bigint, delay_ms double, waiting_for array<string>, session_id string"
)
NS = 1_000_000_000
MS = 1_000_000
