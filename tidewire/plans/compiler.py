"""Compilation of a graph to DataFrames, node by node in topological order.

A node's input is the union of its parents' outputs, each filtered by its edge's path. Branches become conditions on edges, which Catalyst folds into
one filter for each consumer. Nothing runs until an action; validation fails before any plan is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..modules import PythonModule, run_modules
from ..operators import joins, ordered, rows
from ..operators.fusion import lenient
from . import specs as S
from .graph import FlowGraph


class NodeProcessingError(Exception):
    """A node could not be compiled."""

    def __init__(self, node: str, kind: str, original: Exception):
        super().__init__(f"node {node!r} ({kind}): {original}")
        self.node, self.kind, self.original = node, kind, original


@dataclass
class Compiled:
    """Outputs by node. ``results``: rows that no edge takes on; ``terminal``: the results of nodes without edges, which alone fire triggers.
    ``shared``: outputs that are kept while they are read more than once; ``release`` gives them up."""

    graph: FlowGraph
    frames: DataFrame
    outputs: dict[str, DataFrame]
    results: DataFrame
    terminal: DataFrame
    shared: tuple = ()

    def release(self) -> None:
        for df in self.shared:
            df.unpersist()

    def triggers(self, dedupe: bool = False) -> DataFrame:
        return rows.triggers(self.results, dedupe)

    def fired(self) -> DataFrame:
        return rows.fired(self.terminal)


def condition(c, df: DataFrame, on_error: str = "raise") -> Column:
    """A Column from a Column, a function of nothing or of the DataFrame. Null is false; see ``_decided`` for ``drop``."""
    if isinstance(c, Column):
        return c
    import inspect

    return c(df) if inspect.signature(c).parameters else c()


def _decided(df: DataFrame, conditions: dict[str, object], on_error: str) -> DataFrame:
    """``df`` with the conditions as columns. Under ``drop`` they are evaluated leniently: one that fails on a row is null there, and the node drops that row."""
    if on_error == "raise":
        return df.withColumns({n: condition(c, df) for n, c in conditions.items()})
    with lenient(df.sparkSession):
        return df.withColumns({n: condition(c, df, on_error) for n, c in conditions.items()})


def _filter(s, df, on_error):
    if on_error == "raise":
        return rows.keep(df, condition(s.condition, df))
    return _decided(df, {"_c": s.condition}, on_error).where("_c").drop("_c")


def _branch(s, df, on_error):
    if on_error == "raise":
        return rows.branch(df, condition(s.condition, df), s.if_true, s.if_false)
    return rows.branch(_decided(df, {"_c": s.condition}, on_error).where("_c is not null"), F.col("_c"), s.if_true, s.if_false).drop("_c")


def _multi_branch(s, df, on_error):
    """Under ``drop`` a condition that fails before any other holds drops the row, as it would where conditions are tried one by one."""
    if on_error == "raise":
        return rows.multi_branch(df, [(condition(c, df), p) for c, p in s.branches], s.default)
    names = [f"_c{i}" for i in range(len(s.branches))]
    met = _decided(df, dict(zip(names, [c for c, _ in s.branches])), on_error)
    steps = [x for n, (_, p) in zip(names, s.branches) for x in ((F.col(n).isNull(), None), (F.col(n), p))]
    return rows.multi_branch(met, [(c, F.lit(p).cast("string")) for c, p in steps], s.default).drop(*names)


def _conditional_fan_out(s, df, on_error):
    if on_error == "raise":
        return rows.conditional_fan_out(df, [(p, condition(c, df)) for p, c in s.paths])
    names = [f"_c{i}" for i in range(len(s.paths))]
    met = _decided(df, dict(zip(names, [c for _, c in s.paths])), on_error).where(" and ".join(f"{n} is not null" for n in names))
    return rows.conditional_fan_out(met, [(p, F.col(n)) for n, (p, _) in zip(names, s.paths)]).drop(*names)


def _function(f, df, on_error):
    """A function of DataFrames; under ``drop`` what it computes is null where it fails."""
    if on_error == "raise":
        return f(df)
    with lenient(df.sparkSession):
        return f(df)


def _source(n, s, df):
    return df if "observations" in df.columns else rows.to_flow(df, s.default_path_id)


def _extract(name, s, df):
    """Extractors, then the fusion, whose outputs are results where they fire and never observations."""
    out = run_modules(df, s.extractors, name)
    if s.fusion is None or not s.run_fusion:
        return out
    return s.fusion.apply(out).withColumn("observations", F.filter("observations", lambda o: o["source"] != s.fusion.name))


def _same_frames(graph: FlowGraph, node: str, spec: S.Join) -> bool:
    """Whether all the join's paths come from one fan-out with nothing between that drops, adds or batches rows: then each path has each frame once."""
    steady = (S.Modules, S.Extract)
    origins = set()
    for e in graph.incoming(node):
        at = e.source
        while isinstance(graph.nodes[at].spec, steady) and len(graph.incoming(at)) == 1:
            at = graph.incoming(at)[0].source
        origins.add(at)
    if len(origins) != 1:
        return False
    spec_o = graph.nodes[next(iter(origins))].spec
    return isinstance(spec_o, S.FanOut) and set(spec.input_paths) <= set(spec_o.paths)


def _join(node, s, df, graph):
    if s.mode == "all" and s.lateness_ns == 0 and not s.flush and (s.strategy == "frame" or s.strategy == "auto" and _same_frames(graph, node, s)):
        others = df.where(~F.col("path_id").isin(list(s.input_paths)))
        #: By arrival, so that a frame that comes twice is two rows, as in the exact join; ``frame`` says that frames are unique.
        keys = ("stream_id", "frame_id") if s.strategy == "frame" else ("stream_id", "frame_id", "t_ns", "seq")
        met = joins.merge_same_frame(df, list(s.input_paths), s.output_path_id, observations=s.merge_observations, results=s.merge_results, keys=keys)
        return rows.union(met, others)
    rank = F.element_at(F.create_map(*[x for i, p in enumerate(s.input_paths) for x in (F.lit(p), F.lit(i))]), F.col("path_id"))
    ordered_ = df.withColumn("_rank", F.coalesce(rank, F.lit(len(s.input_paths))))
    return joins.join_paths(ordered_, list(s.input_paths), s.mode, s.window_ns, s.lateness_ns, s.output_path_id, s.merge_observations, s.merge_results, s.flush, ("t_ns", "seq", "_rank")).drop("_rank")


COMPILERS: dict[type, Callable] = {
    S.Source: lambda n, s, df, g: _source(n, s, df),
    S.Modules: lambda n, s, df, g: run_modules(df, s.modules, n),
    S.Extract: lambda n, s, df, g: _extract(n, s, df),
    S.Filter: lambda n, s, df, g: _filter(s, df, s.on_error),
    S.ObservationFilter: lambda n, s, df, g: rows.min_observations(df, s.min_count),
    S.SignalFilter: lambda n, s, df, g: rows.keep(df, rows.any_signal(s.signal, s.comparison, s.threshold)),
    S.Sample: lambda n, s, df, g: ordered.every_nth(df, s.every_nth, s.mode, s.bucket_ns),
    S.RateLimit: lambda n, s, df, g: ordered.min_interval(df, int(s.min_interval_ms * 1_000_000), s.time_column, s.bucket_ns),
    S.TimestampSample: lambda n, s, df, g: ordered.min_interval(df, s.interval_ns, bucket_ns=s.bucket_ns),
    S.Branch: lambda n, s, df, g: _branch(s, df, s.on_error),
    S.FanOut: lambda n, s, df, g: rows.fan_out(df, list(s.paths)),
    S.MultiBranch: lambda n, s, df, g: _multi_branch(s, df, s.on_error),
    S.ConditionalFanOut: lambda n, s, df, g: _conditional_fan_out(s, df, s.on_error),
    S.Join: lambda n, s, df, g: _join(n, s, df, g),
    S.CascadeFusion: lambda n, s, df, g: _function(s.fusion_fn, df, s.on_error),
    S.Collector: lambda n, s, df, g: joins.collect_batches(df, s.batch_size, s.flush and s.emit_partial, s.bucket_ns),
    S.Custom: lambda n, s, df, g: _function(s.processor, df, s.on_error),
}


def _dear(spec) -> bool:
    """Whether a node's rows come from Python or from an ordered pass over streams."""
    if isinstance(spec, (S.Modules, S.Extract)):
        mine = spec.modules() if isinstance(spec, S.Extract) else spec.modules
        return any(isinstance(m, PythonModule) or m.stateful for m in mine)
    return isinstance(spec, (S.RateLimit, S.TimestampSample, S.Join, S.Collector, S.Custom)) or isinstance(spec, S.Sample) and spec.mode == "count"


def register(spec: type, compile_: Callable) -> None:
    """How nodes of another spec are compiled: a function of (name, spec, DataFrame, graph)."""
    COMPILERS[spec] = compile_


def compile_graph(graph: FlowGraph, frames: DataFrame, on_node: Callable[[str, DataFrame], DataFrame] | None = None, drop_after: dict[str, str] | None = None, on_error: str | None = None, share: bool = True) -> Compiled:
    """``on_error``, if given, goes for all nodes that have such a policy. ``share``: an output that several nodes read is kept (in memory, then on disk) if Python or
    an ordered pass made it, so that this runs once; cheap Columns are computed again by each reader instead. ``on_node(name, df)`` may wrap each node's output, for instance with ``df.observe``.

    ``drop_after``: payload column to the node that reads it last. Columns that only Columns read are pruned without it; Python nodes and ordered scans
    carry what they are given, so heavy payloads should end here.
    """
    graph.validate()
    if on_error not in (None, *S.ERRORS):
        raise ValueError("on_error is 'raise' or 'drop'")
    outputs: dict[str, DataFrame] = {}
    dear: set[str] = set()
    shared: list[DataFrame] = []
    taken: list[DataFrame] = []
    ends: list[DataFrame] = []
    for name in graph.topological():
        spec = graph.nodes[name].spec
        if on_error and hasattr(spec, "on_error"):
            spec = replace(spec, on_error=on_error)
        if type(spec) not in COMPILERS:
            raise TypeError(f"nothing compiles {type(spec).__name__}; see register()")
        parts = []
        for e in graph.incoming(name):
            parent = outputs[e.source]
            parts.append(parent if e.path_filter is None else parent.where(F.col("path_id") == e.path_filter))
        df = rows.union(*parts) if parts else frames
        try:
            df = COMPILERS[type(spec)](name, spec, df, graph)
        except (ValueError, TypeError, KeyError) as e:
            raise NodeProcessingError(name, type(spec).__name__, e) from e
        if gone := [c for c, n in (drop_after or {}).items() if n == name]:
            df = df.drop(*gone)
        outputs[name] = on_node(name, df) if on_node else df
        edges = graph.outgoing(name)
        if _dear(spec) or any(e.source in dear for e in graph.incoming(name)):
            dear.add(name)
            if share and len(edges) > 1 and not df.isStreaming:
                outputs[name] = outputs[name].persist(StorageLevel.MEMORY_AND_DISK)
                shared.append(outputs[name])
                dear.discard(name)
        if not edges:
            ends.append(outputs[name])
            taken.append(outputs[name])
        elif all(e.path_filter is not None for e in edges):  # rows of other paths end here
            taken.append(outputs[name].where(~F.col("path_id").isin([e.path_filter for e in edges])))
    return Compiled(graph, frames, outputs, rows.union(*taken), rows.union(*ends), tuple(shared))
