"""Fluent building of graphs: each call adds a node after the last one; paths that a branch makes are continued by ``path``."""

from __future__ import annotations

from collections.abc import Callable

from .. import registry
from . import specs as S
from .graph import FlowGraph


class FlowGraphBuilder:
    def __init__(self):
        self._graph = FlowGraph()
        self._last: str | None = None
        self._ends: dict[str, str] = {}  # path to its last node
        self._made: dict[str, str] = {}  # path to the node that made it
        self._count: dict[str, int] = {}
        self._known: dict[str, object] = {}

    def _name(self, given: str | None, kind: str) -> str:
        if given:
            return given
        self._count[kind] = self._count.get(kind, 0) + 1
        n = self._count[kind]
        return kind if n == 1 else f"{kind}_{n}"

    def _add(self, name: str | None, kind: str, spec, after: str | None = None, path: str | None = None) -> FlowGraphBuilder:
        name = self._name(name, kind)
        self._graph.add_node(name, spec)
        after = after or self._last
        if after:
            self._graph.add_edge(after, name, path)
        self._last = name
        return self

    def register(self, name: str, module) -> FlowGraphBuilder:
        """A module that ``path`` may name."""
        self._known[name] = module
        return self

    register_module = register_extractor = register_fusion = register

    def _resolve(self, m):
        return self._known.get(m) or registry.get_module(m) if isinstance(m, str) else m

    def source(self, name: str | None = None, default_path_id: str = "default") -> FlowGraphBuilder:
        return self._add(name, "source", S.Source(default_path_id))

    def filter(self, condition, name: str | None = None, on_error: str = "raise") -> FlowGraphBuilder:
        return self._add(name, "filter", S.Filter(condition, on_error))

    def filter_observations(self, min_count: int = 1, name: str | None = None) -> FlowGraphBuilder:
        return self._add(name, "observation_filter", S.ObservationFilter(min_count))

    def filter_signal(self, signal: str, threshold: float, comparison: str = "gt", name: str | None = None) -> FlowGraphBuilder:
        return self._add(name, "signal_filter", S.SignalFilter(signal, threshold, comparison))

    def sample(self, every_nth: int, name: str | None = None, mode: str = "count", bucket_ns: int | None = None) -> FlowGraphBuilder:
        return self._add(name, "sampler", S.Sample(every_nth, mode, bucket_ns))

    def rate_limit(self, min_interval_ms: float, name: str | None = None, time_column: str = "timestamp_ns", bucket_ns: int | None = None) -> FlowGraphBuilder:
        return self._add(name, "rate_limiter", S.RateLimit(min_interval_ms, time_column, bucket_ns))

    def sample_time(self, interval_ns: int, name: str | None = None, bucket_ns: int | None = None) -> FlowGraphBuilder:
        return self._add(name, "timestamp_sampler", S.TimestampSample(interval_ns, bucket_ns))

    def _routes(self, paths, node: str) -> None:
        for p in paths:
            if p is not None:
                self._made[p] = self._ends[p] = node

    def branch(self, condition, if_true: str, if_false: str, name: str | None = None, on_error: str = "raise") -> FlowGraphBuilder:
        self._add(name, "branch", S.Branch(condition, if_true, if_false, on_error))
        self._routes((if_true, if_false), self._last)
        return self

    def fanout(self, paths: list[str], name: str | None = None) -> FlowGraphBuilder:
        self._add(name, "fanout", S.FanOut(tuple(paths)))
        self._routes(paths, self._last)
        return self

    def multi_branch(self, branches: list, default: str | None = None, name: str | None = None, on_error: str = "raise") -> FlowGraphBuilder:
        self._add(name, "multi_branch", S.MultiBranch(tuple(branches), default, on_error))
        self._routes([*(p for _, p in branches), default], self._last)
        return self

    def conditional_fanout(self, paths: list, name: str | None = None, on_error: str = "raise") -> FlowGraphBuilder:
        self._add(name, "conditional_fanout", S.ConditionalFanOut(tuple(paths), on_error))
        self._routes([p for p, _ in paths], self._last)
        return self

    def path(self, name: str, modules: list | None = None, extractors: list | None = None, fusion=None, run_fusion: bool = True, parallel: bool = False) -> FlowGraphBuilder:
        """Modules on a path. If a branch or fan-out made the path, the node takes that path's rows only."""
        if modules is not None:
            spec = S.Modules(tuple(self._resolve(m) for m in modules), parallel)
        else:
            spec = S.Extract(tuple(self._resolve(m) for m in extractors or ()), self._resolve(fusion) if fusion else None, run_fusion, parallel)
        made = self._made.get(name)
        self._add(name, "path", spec, self._ends.get(name), name if made and self._ends.get(name) == made else None)
        self._ends[name] = self._last
        return self

    def join(self, input_paths: list[str], mode: str = "all", window_ns: int = 100_000_000, output_path_id: str = "merged", name: str | None = None, **options) -> FlowGraphBuilder:
        """A node after the last node of each input path. A path without a node of its own comes straight from the node that made it."""
        name = self._name(name, "join")
        self._graph.add_node(name, S.Join(tuple(input_paths), mode, window_ns, output_path_id=output_path_id, **options))
        wired = False
        for p in input_paths:
            end = self._ends.get(p)
            if end is not None:
                self._graph.add_edge(end, name, p if end == self._made.get(p) else None)
                wired = True
        if not wired and self._last:
            self._graph.add_edge(self._last, name)
        self._last = name
        self._ends[output_path_id] = name
        return self

    def cascade_fusion(self, fusion_fn: Callable, name: str | None = None, on_error: str = "raise") -> FlowGraphBuilder:
        return self._add(name, "cascade", S.CascadeFusion(fusion_fn, on_error))

    def collect(self, batch_size: int = 0, timeout_ns: int = 0, emit_partial: bool = True, flush: bool = False, name: str | None = None, bucket_ns: int | None = None) -> FlowGraphBuilder:
        return self._add(name, "collector", S.Collector(batch_size, timeout_ns, emit_partial, flush, bucket_ns))

    def custom(self, processor: Callable, name: str | None = None, on_error: str = "raise") -> FlowGraphBuilder:
        return self._add(name, "custom", S.Custom(processor, on_error=on_error))

    def add_node(self, name: str, spec) -> FlowGraphBuilder:
        return self._add(name, "node", spec)

    def edge(self, source: str, target: str, path_filter: str | None = None) -> FlowGraphBuilder:
        self._graph.add_edge(source, target, path_filter)
        return self

    def on_trigger(self, callback: Callable) -> FlowGraphBuilder:
        self._graph.on_trigger(callback)
        return self

    def build(self) -> FlowGraph:
        return self._graph.validate()
