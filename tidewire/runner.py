"""Running graphs: one call from modules and frames to triggers."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import observability as obs
from . import registry, sinks
from .plans.compiler import Compiled, compile_graph
from .plans.graph import FlowGraph
from .sources.frames import duration_sec, video_files


@dataclass
class ProcessResult:
    """Triggers as a DataFrame, counts, and statistics."""

    triggers: DataFrame
    frame_count: int
    duration_sec: float
    stats: dict = field(default_factory=dict)


def process(graph: FlowGraph, frames: DataFrame, on_trigger: Callable | None = None, fps: float = 10.0, hub: obs.Hub | None = None, dedupe: bool = False) -> ProcessResult:
    """Compile, run, call back for triggers at terminal nodes, and count. The graph is not changed, and may be run again."""
    hub = hub or obs.Hub()
    began = time.time()
    session = f"run-{time.time_ns()}"
    if hub.enabled:
        hub.emit(obs.session_start(session, extractors=list(graph.nodes)))
    compiled: Compiled = compile_graph(graph, frames)
    triggers = compiled.triggers(dedupe)
    callbacks = [*graph.callbacks]
    if callbacks:
        sinks.call_back(compiled.fired(), callbacks)
    n_triggers = sinks.call_back(triggers, [on_trigger]) if on_trigger else triggers.count()
    count = frames.count()
    took = time.time() - began
    if hub.enabled:
        hub.emit(obs.session_end(session, took, count, n_triggers))
    stats = {"frames": count, "triggers": n_triggers, "wall_sec": took, "throughput_fps": count / took if took > 0 else 0.0}
    return ProcessResult(triggers, count, duration_sec(count, fps), stats)


def process_video(spark: SparkSession, video: str | DataFrame, modules: list, fps: float = 10.0, on_trigger: Callable | None = None, decode=None) -> ProcessResult:
    """Modules, by name or as objects, on a video file, a folder of them, or a DataFrame of frames."""
    found = [registry.get_module(m) if isinstance(m, str) else m for m in modules]
    frames = video if isinstance(video, DataFrame) else video_files(spark, video, fps, decode)
    return process(FlowGraph.from_modules(found), frames, on_trigger, fps)


def stream(graph: FlowGraph, frames: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Stateless graphs on a stream: triggers go to ``sink`` by micro-batch. Every micro-batch is compiled as batch input, so ordered nodes see one
    micro-batch at a time; for state across them use ``tidewire.streaming``."""
    from .streaming import run

    return run(frames, lambda df, n: sink(compile_graph(graph, df).triggers(), n), checkpoint, available_now=available_now)


def summary(result: ProcessResult) -> dict:
    return {"frames": result.frame_count, "duration_sec": result.duration_sec, **result.stats}


def count_by_node(compiled: Compiled) -> DataFrame:
    """Rows that left each node, in one job."""
    from functools import reduce

    return reduce(DataFrame.unionAll, [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("node"), "rows") for n, df in compiled.outputs.items()])
