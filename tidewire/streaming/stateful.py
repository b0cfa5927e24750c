"""Stateful operators on Structured Streaming. Stateless operators are the batch functions themselves.

Each keeps one stream's state by ``applyInPandasWithState`` and calls the same step as the batch form. Rows of a micro-batch are put in (t_ns, seq) order first;
across micro-batches the order is that of arrival.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import functions as fn
from ..operators.joins import PathBuffer, one_of
from ..operators.ordered import cooling, greedy


def _with_state(df: DataFrame, schema, start: Callable[[], object], step: Callable[[object, pd.DataFrame], pd.DataFrame], dumps, loads, kind: str, keys=("stream_id",)) -> DataFrame:
    def run(_key, frames, state):
        s = loads(state.get[0]) if state.exists else start()
        rows = [f for f in frames]
        out = step(s, pd.concat(rows).sort_values(["t_ns", "seq"], kind="stable")) if rows else None
        state.update((dumps(s),))
        if out is not None and len(out):
            yield out

    return df.groupBy(*keys).applyInPandasWithState(run, schema, f"s {kind}", "append", GroupStateTimeout.NoTimeout)


def _filtered(df: DataFrame, start, passes) -> DataFrame:
    def step(s, rows):
        return rows[[passes(s, r) for r in rows.itertuples(index=False)]]

    return _with_state(df, df.schema, start, step, json.dumps, json.loads, "string")


def every_nth(df: DataFrame, n: int) -> DataFrame:
    def passes(s, _):
        s["n"] = s.get("n", 0) + 1
        return s["n"] % n == 0

    return _filtered(df, dict, passes)


def min_interval(df: DataFrame, interval_ns: int, time: str = "t_ns") -> DataFrame:
    return _filtered(df, dict, lambda s, r: greedy(s, int(getattr(r, time)), interval_ns))


def rate_limit(df: DataFrame, min_interval_ms: float) -> DataFrame:
    """By the clock: rows that come too soon after the last that passed are dropped. What passes depends on when rows come."""
    import time

    return _filtered(df, dict, lambda s, r: greedy(s, time.time_ns(), int(min_interval_ms * 1_000_000)))


def cooldown(df: DataFrame, candidate: str, wait_ns: int) -> DataFrame:
    """The rows that fire."""
    return _filtered(df, dict, lambda s, r: cooling(s, int(r.t_ns), wait_ns, bool(getattr(r, candidate)))[0])


def fuse(df: DataFrame, sources: list[str], decide: Callable[[dict], tuple[str, float] | None], wait_ns: int, value: str = "value") -> DataFrame:
    """Decisions over each source's latest value: (stream_id, frame_id, t_ns, state, score, reason) for every row of (stream_id, frame_id, t_ns, seq, source, value).

    The order of decisions is that of the batch form: cool-down, missing sources, no trigger, fire; latest values move on in a cool-down too.
    """

    def step(s, rows):
        out = []
        for r in rows.itertuples(index=False):
            if r.source in sources:
                s.setdefault("latest", {})[r.source] = float(getattr(r, value))
            have = s.get("latest", {})
            verdict = decide(have) if all(x in have for x in sources) else None
            fires, cool = cooling(s, int(r.t_ns), wait_ns, verdict is not None)
            state = "cooldown" if cool else "missing_sources" if len(have) < len(sources) else "triggered" if fires else "no_trigger"
            out.append((r.stream_id, r.frame_id, r.t_ns, state, verdict[1] if fires else 0.0, verdict[0] if fires else ""))
        return pd.DataFrame(out, columns=["stream_id", "frame_id", "t_ns", "state", "score", "reason"])

    return _with_state(df, "stream_id string, frame_id bigint, t_ns bigint, state string, score double, reason string", dict, step, json.dumps, json.loads, "string")


def join_paths(df: DataFrame, paths: list[str], window_ns: int = 100_000_000, lateness_ns: int = 0, out_path: str = "merged", mode: str = "all", observations: bool = True, results: bool = True) -> DataFrame:
    """The exact path join: what is held is kept between micro-batches."""

    def step(s, rows):
        out = [o for r in rows.to_dict("records") for o in s.push(r)]
        return pd.DataFrame(out, columns=rows.columns)

    return _with_state(df, df.schema, lambda: PathBuffer(paths, mode, window_ns, lateness_ns, observations, results, out_path), step, pickle.dumps, pickle.loads, "binary")


def collect_batches(df: DataFrame, size: int) -> DataFrame:
    """Every ``size`` flow rows of a stream as one, whole, as the batch form makes them. The state holds rows as JSON, under ``size`` of them."""
    n = max(1, size)
    others = [c for c in df.columns if c not in ("stream_id", "observations", "results", "metadata")]
    row = F.struct("observations", "results", F.map_entries("metadata").alias("metadata"), *others)
    packed = df.select("stream_id", "t_ns", "seq", F.to_json(row, {"ignoreNullFields": "false"}).alias("row"))

    def step(s, rows):
        s += rows["row"].tolist()
        out = []
        while len(s) >= n:
            out.append({"stream_id": rows["stream_id"].iloc[0], "rows": s[:n]})
            del s[:n]
        return pd.DataFrame(out, columns=["stream_id", "rows"])

    kind = df.select(row.alias("row")).schema["row"].dataType
    met = _with_state(packed, "stream_id string, rows array<string>", list, step, json.dumps, json.loads, "string")
    return one_of(met.select("stream_id", F.transform("rows", lambda r: F.from_json(r, kind)).alias("_rows")), df.columns)


def interval_join(left: DataFrame, right: DataFrame, window_ns: int, lateness: str = "10 seconds") -> DataFrame:
    """Pairs of a stream at most ``window_ns`` apart, with watermarks so that state ends."""
    us = -(-window_ns // 1000)
    span = F.expr(f"make_dt_interval(0, 0, 0, {us} / 1000000.0D)") if us < 1_000_000 else F.expr(f"make_dt_interval(0, 0, 0, cast({us / 1e6} as decimal(18, 6)))")
    a = left.withColumn("event_ts", fn.event_time(F.col("t_ns"))).withWatermark("event_ts", lateness)
    b = right.select(*[F.col(c).alias(f"{c}_right") for c in right.columns]).withColumn("event_ts_right", fn.event_time(F.col("t_ns_right"))).withWatermark("event_ts_right", lateness)
    near = (F.col("stream_id") == F.col("stream_id_right")) & (F.col("event_ts_right") >= F.col("event_ts") - span) & (F.col("event_ts_right") <= F.col("event_ts") + span)
    return a.join(b, near).where(F.abs(F.col("t_ns_right") - F.col("t_ns")) <= window_ns).drop("event_ts", "event_ts_right", "stream_id_right")


def tumbling(df: DataFrame, width: str, lateness: str = "10 seconds") -> DataFrame:
    """Rows of each stream by fixed windows of event time: count and times; late rows are dropped after ``lateness``."""
    w = df.withColumn("event_ts", fn.event_time(F.col("t_ns"))).withWatermark("event_ts", lateness)
    return w.groupBy("stream_id", F.window("event_ts", width)).agg(F.count("*").alias("n"), F.min("t_ns").alias("first_ns"), F.max("t_ns").alias("last_ns"))


def align(messages: DataFrame, window_ns: int = 100_000_000) -> DataFrame:
    """Messages gathered by frame, each source's last one; a frame is released once the stream's newest time is more than ``window_ns`` past its first.

    (stream_id, frame_id, first_ns, last_ns, delay_ns, sources, messages), a message's other columns as JSON. What comes for a frame after its release
    makes a frame anew, as nothing of it is held any more.
    """
    others = [c for c in messages.columns if c not in ("stream_id", "frame_id", "source")]
    packed = messages.select("stream_id", "frame_id", "source", "t_ns", "seq", F.to_json(F.struct(*others)).alias("message"))

    def step(s, rows):
        frames = s.setdefault("frames", {})
        for r in rows.itertuples(index=False):
            f = frames.setdefault(str(r.frame_id), {})
            if r.source not in f or f[r.source][1] <= r.seq:
                f[r.source] = [int(r.t_ns), int(r.seq), r.message]
            s["newest"] = max(s.get("newest", int(r.t_ns)), int(r.t_ns))
        out = []
        for k in sorted(frames, key=int):
            t = [m[0] for m in frames[k].values()]
            if s["newest"] - min(t) > window_ns:
                f = frames.pop(k)
                out.append((rows["stream_id"].iloc[0], int(k), min(t), max(t), s["newest"] - min(t), sorted(f), [f[x][2] for x in sorted(f)]))
        return pd.DataFrame(out, columns=["stream_id", "frame_id", "first_ns", "last_ns", "delay_ns", "sources", "messages"])

    schema = "stream_id string, frame_id bigint, first_ns bigint, last_ns bigint, delay_ns bigint, sources array<string>, messages array<string>"
    return _with_state(packed, schema, dict, step, json.dumps, json.loads, "string")


def to_table(df: DataFrame, path: str) -> DataFrame:
    """Take what is there, write it as Parquet and read it."""
    w = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    w.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "100 milliseconds", available_now: bool = False):
    """Start a query that hands each micro-batch to ``sink``; ``available_now`` takes what is there and ends."""
    w = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
