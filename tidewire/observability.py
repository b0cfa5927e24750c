"""Traces: records with levels, sinks, and statistics over the trace table."""

from __future__ import annotations

import dataclasses
import enum
import json
import sys
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import functions as fn
from .schema import TRACE


class TraceLevel(enum.IntEnum):
    OFF, MINIMAL, NORMAL, VERBOSE = range(4)


@dataclasses.dataclass
class Record:
    """Fields of a trace record. ``type`` names it; ``min_level`` is the level from which it is kept, and is not written."""

    type: str
    min_level: TraceLevel = TraceLevel.NORMAL
    timestamp_ns: int = dataclasses.field(default_factory=time.time_ns)
    fields: dict = dataclasses.field(default_factory=dict)

    def to_dict(self) -> dict:
        return {"record_type": self.type, "timestamp_ns": self.timestamp_ns, **self.fields}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)


def timing(frame_id: int, component: str, processing_ms: float, queue_depth: int = 0, threshold_ms: float = 50.0) -> Record:
    return Record("timing", TraceLevel.NORMAL, fields={"frame_id": frame_id, "component": component, "processing_ms": processing_ms, "queue_depth": queue_depth, "threshold_ms": threshold_ms, "is_slow": processing_ms > threshold_ms})


def frame_drop(ids: list[int], reason: str, queue_depth: int = 0, processing_ms: float = 0.0) -> Record:
    return Record("frame_drop", TraceLevel.MINIMAL, fields={"dropped_frame_ids": ids, "reason": reason, "queue_depth": queue_depth, "processing_ms": processing_ms})


def sync_delay(frame_id: int, expected_ns: int, actual_ns: int, waiting_for: list[str]) -> Record:
    return Record("sync_delay", TraceLevel.MINIMAL, fields={"frame_id": frame_id, "expected_ns": expected_ns, "actual_ns": actual_ns, "delay_ms": (actual_ns - expected_ns) / 1e6, "waiting_for": waiting_for})


def fps_summary(**fields) -> Record:
    return Record("fps_summary", TraceLevel.MINIMAL, fields=fields)


def frame_extract(frame_id: int, component: str, **fields) -> Record:
    return Record("frame_extract", TraceLevel.VERBOSE, fields={"frame_id": frame_id, "component": component, **fields})


def session_start(session_id: str, source_path: str = "", target_fps: float = 10.0, extractors: list[str] | None = None, config: dict | None = None, trace_level: str = "normal") -> Record:
    return Record("session_start", TraceLevel.MINIMAL, fields={"session_id": session_id, "source_path": source_path, "target_fps": target_fps, "extractors": extractors or [], "config": config or {}, "trace_level": trace_level})


def session_end(session_id: str, duration_sec: float, total_frames: int, total_triggers: int, total_events: int = 0, total_dropped: int = 0) -> Record:
    fps = total_frames / duration_sec if duration_sec > 0 else 0.0
    return Record("session_end", TraceLevel.MINIMAL, fields={"session_id": session_id, "duration_sec": duration_sec, "total_frames": total_frames, "total_triggers": total_triggers, "total_events": total_events, "total_dropped": total_dropped, "avg_fps": fps})


class Sink:
    def write(self, record: Record) -> None:
        raise NotImplementedError

    def flush(self) -> None: ...

    def close(self) -> None:
        self.flush()


class NullSink(Sink):
    def write(self, record: Record) -> None: ...


class FileSink(Sink):
    """JSON lines on the driver, buffered. Tables of traces are written with ``write_trace``."""

    def __init__(self, path: str, buffer_size: int = 100, append: bool = False):
        from pathlib import Path

        self.path, self.size, self.held = Path(path), buffer_size, []
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self._file = self.path.open("a" if append else "w", encoding="utf-8")

    def write(self, record: Record) -> None:
        self.held.append(record.to_json())
        if len(self.held) >= self.size:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self._file.write("\n".join(self.held) + "\n")
            self.held.clear()
        self._file.flush()

    def close(self) -> None:
        self.flush()
        self._file.close()


class MemorySink(Sink):
    """The last ``max_records`` records."""

    def __init__(self, max_records: int = 10_000):
        self.records: deque[Record] = deque(maxlen=max_records)

    def write(self, record: Record) -> None:
        self.records.append(record)

    def get_records(self, kind: str | None = None) -> list[Record]:
        return [r for r in self.records if kind is None or r.type == kind]

    def get_by_frame(self, frame_id: int) -> list[Record]:
        return [r for r in self.records if r.fields.get("frame_id") == frame_id]

    def timing_stats(self) -> dict[str, dict]:
        by: dict[str, list] = {}
        for r in self.get_records("timing"):
            by.setdefault(r.fields["component"], []).append(r.fields)
        return {c: {"count": len(x), "avg_ms": sum(f["processing_ms"] for f in x) / len(x), "max_ms": max(f["processing_ms"] for f in x), "min_ms": min(f["processing_ms"] for f in x), "slow_count": sum(f["is_slow"] for f in x)} for c, x in by.items()}

    def clear(self) -> None:
        self.records.clear()

    def __len__(self) -> int:
        return len(self.records)


class ConsoleSink(Sink):
    """Slow timings, drops and delays as lines; colour on terminals only."""

    def __init__(self, stream=None, color: bool | None = None, show_timing_warnings: bool = True, timing_threshold_ms: float = 50.0, format_fn: Callable[[Record], str | None] | None = None):
        self.stream = stream or sys.stderr
        self.color = self.stream.isatty() if color is None and hasattr(self.stream, "isatty") else bool(color)
        self.warn, self.threshold, self.format = show_timing_warnings, timing_threshold_ms, format_fn or self.line

    def line(self, r: Record) -> str | None:
        f = r.fields
        if r.type == "timing" and self.warn and f["processing_ms"] > self.threshold:
            return f"SLOW {f['component']} frame {f['frame_id']}: {f['processing_ms']:.1f} ms"
        if r.type == "frame_drop":
            ids = f["dropped_frame_ids"]
            return f"DROP {', '.join(map(str, ids[:5]))}" + (f" +{len(ids) - 5} more" if len(ids) > 5 else "") + f": {f['reason']}"
        if r.type == "sync_delay":
            return f"SYNC frame {f['frame_id']}: {f['delay_ms']:.1f} ms, waiting for {', '.join(f['waiting_for'])}"
        return None

    def write(self, record: Record) -> None:
        if text := self.format(record):
            self.stream.write((f"\033[33m{text}\033[0m" if self.color else text) + "\n")


class Hub:
    """Sends records that the level admits to every sink; a sink's failure stops no other. Off costs one comparison."""

    def __init__(self, level: TraceLevel = TraceLevel.OFF, sinks: list[Sink] | None = None):
        self.level, self.sinks = level, list(sinks or [])

    @property
    def enabled(self) -> bool:
        return self.level > TraceLevel.OFF

    def emit(self, record: Record) -> None:
        if record.min_level > self.level or not self.enabled:
            return
        for s in self.sinks:
            try:
                s.write(record)
            except Exception:  # noqa: BLE001, S110  a sink must not stop the run
                pass

    def close(self) -> None:
        for s in self.sinks:
            s.close()


def trace_table(spark, records: list[Record]) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(TRACE)
    return spark.createDataFrame([tuple((r.to_dict() | {"min_level": int(r.min_level)}).get(c) for c in schema.names) for r in records], schema)


def admitted(trace: DataFrame, level: int) -> DataFrame:
    return trace.where(F.col("min_level") <= int(level))


def write_trace(trace: DataFrame, path: str, append: bool = False) -> None:
    trace.drop("min_level").write.mode("append" if append else "overwrite").json(path)


def console_lines(trace: DataFrame, threshold_ms: float = 50.0) -> DataFrame:
    """A column ``line`` for what a console shows, over a whole trace table."""
    line = (
        F.when((F.col("record_type") == "timing") & (F.col("processing_ms") > threshold_ms), F.format_string("SLOW %s frame %d: %.1f ms", "component", "frame_id", "processing_ms"))
        .when(F.col("record_type") == "frame_drop", F.concat(F.lit("DROP "), fn.first_ids(F.col("dropped_frame_ids")), F.lit(": "), F.col("reason")))
        .when(F.col("record_type") == "sync_delay", F.concat(F.format_string("SYNC frame %d: %.1f ms, waiting for ", "frame_id", "delay_ms"), F.array_join("waiting_for", ", ")))
    )
    return trace.withColumn("line", line).where("line is not null")


def slow(df: DataFrame, value: str, threshold_ms: float) -> DataFrame:
    return df.withColumn("is_slow", F.col(value) > threshold_ms)


def last_records(trace: DataFrame, n: int = 10_000, order: str | tuple = "timestamp_ns") -> DataFrame:
    """The newest n records: the ring buffer of a memory sink."""
    return trace.orderBy(*[F.desc(c) for c in ((order,) if isinstance(order, str) else order)]).limit(n)


def observed(name: str, df: DataFrame) -> DataFrame:
    """Rows that leave a node, counted as they pass: ``df.observe`` metrics named ``node_<name>``."""
    return df.observe(f"node_{name}", F.count(F.lit(1)).alias("rows"))
