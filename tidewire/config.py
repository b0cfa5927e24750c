"""Configuration: YAML pipelines and graphs, with variables from the environment, checked before use."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from typing import Any

from . import observability as obs
from .plans import specs as S
from .plans.graph import FlowGraph

_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")
SINKS = ("file", "console", "memory", "null")
#: Node types of graph files and the keys they need.
NODES = {
    "source": (S.Source, ()), "filter": (S.Filter, ("condition",)), "observation_filter": (S.ObservationFilter, ()), "signal_filter": (S.SignalFilter, ("signal", "threshold")), "sampler": (S.Sample, ("every_nth",)),
    "rate_limiter": (S.RateLimit, ("min_interval_ms",)), "timestamp_sampler": (S.TimestampSample, ("interval_ns",)), "branch": (S.Branch, ("condition", "if_true", "if_false")), "fanout": (S.FanOut, ("paths",)),
    "multi_branch": (S.MultiBranch, ("branches",)), "conditional_fanout": (S.ConditionalFanOut, ("paths",)), "join": (S.Join, ("input_paths",)), "collector": (S.Collector, ()), "path": (S.Modules, ("modules",)),
}


def substitute(value: Any, environ: dict | None = None) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` in all strings; a missing one without a default is a KeyError."""
    env = os.environ if environ is None else environ
    if isinstance(value, str):

        def put(m):
            if m[1] in env:
                return env[m[1]]
            if m[2] is None:
                raise KeyError(m[1])
            return m[2]

        return _VARIABLE.sub(put, value)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    return [substitute(v, env) for v in value] if isinstance(value, list) else value


@dataclass
class SinkConfig:
    type: str
    path: str | None = None
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.type not in SINKS:
            raise ValueError(f"a sink's type is one of {', '.join(SINKS)}")
        if self.type == "file" and not self.path:
            raise ValueError("a file sink needs a path")

    def make(self) -> obs.Sink:
        if self.type == "file":
            return obs.FileSink(self.path, **self.options)
        return {"console": obs.ConsoleSink, "memory": obs.MemorySink, "null": obs.NullSink}[self.type](**self.options)


@dataclass
class ObservabilityConfig:
    enabled: bool = False
    level: str = "normal"
    sinks: list = field(default_factory=list)

    def __post_init__(self):
        self.sinks = [s if isinstance(s, SinkConfig) else SinkConfig(**s) for s in self.sinks]
        if self.level.upper() not in obs.TraceLevel.__members__:
            raise ValueError(f"unknown trace level {self.level!r}")

    def hub(self) -> obs.Hub:
        return obs.Hub(obs.TraceLevel[self.level.upper()] if self.enabled else obs.TraceLevel.OFF, [s.make() for s in self.sinks])


@dataclass
class ExtractorConfig:
    name: str
    isolation: str = "inline"
    requirements: str | None = None
    venv: str | None = None
    image: str | None = None
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        from .modules import LEVELS

        self.isolation = self.isolation.lower()
        if self.isolation not in LEVELS:
            raise ValueError(f"unknown isolation level {self.isolation!r}")
        if self.isolation == "venv" and not self.venv:
            raise ValueError(f"extractor {self.name!r}: venv isolation needs 'venv'")
        if self.isolation == "container" and not self.image:
            raise ValueError(f"extractor {self.name!r}: container isolation needs 'image'")


@dataclass
class FusionConfig:
    name: str
    cooldown: float = 2.0
    params: dict = field(default_factory=dict)


@dataclass
class PipelineConfig:
    extractors: list
    fusion: Any = None
    observability: Any = None

    def __post_init__(self):
        self.extractors = [e if isinstance(e, ExtractorConfig) else ExtractorConfig(**({"name": e} if isinstance(e, str) else e)) for e in self.extractors]
        if not self.extractors:
            raise ValueError("a pipeline needs an extractor")
        if isinstance(self.fusion, (dict, str)):
            self.fusion = FusionConfig(**({"name": self.fusion} if isinstance(self.fusion, str) else self.fusion))
        self.observability = ObservabilityConfig(**(self.observability or {})) if not isinstance(self.observability, ObservabilityConfig) else self.observability

    def graph(self) -> FlowGraph:
        from . import registry

        names = [e.name for e in self.extractors] + ([self.fusion.name] if self.fusion else [])
        return FlowGraph.from_modules([registry.get_module(n) for n in names])


@dataclass
class Config:
    pipelines: dict
    version: str = "1.0"
    globals: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.version != "1.0":
            raise ValueError(f"unknown version {self.version!r}")
        if not self.pipelines:
            raise ValueError("a configuration needs a pipeline")
        base = self.globals.get("observability")
        self.pipelines = {k: PipelineConfig(**({"observability": base} | p)) if isinstance(p, dict) else p for k, p in self.pipelines.items()}


def load(text: str, variables: bool = True, environ: dict | None = None) -> Config:
    import yaml

    data = yaml.safe_load(text) or {}
    return Config(**(substitute(data, environ) if variables else data))


def load_file(path: str, variables: bool = True) -> Config:
    with open(path, encoding="utf-8") as f:
        return load(f.read(), variables)


def graph_from(data: dict) -> FlowGraph:
    """A graph from nodes (name, type and its keys) and edges (source, target, path). Conditions are SQL expressions; modules are names."""
    from pyspark.sql import functions as F

    from . import registry

    def sql(text):
        return lambda: F.expr(text)

    g = FlowGraph()
    for n in data.get("nodes", []):
        n = dict(n)
        name, kind = n.pop("name"), n.pop("type")
        if kind not in NODES:
            raise ValueError(f"unknown node type {kind!r}")
        spec, need = NODES[kind]
        if missing := [k for k in need if k not in n]:
            raise ValueError(f"node {name!r} needs {missing}")
        if "condition" in n:
            n["condition"] = sql(n["condition"])
        if kind == "multi_branch":
            n["branches"] = tuple((sql(b["condition"]), b["path"]) for b in n["branches"])
        if kind == "conditional_fanout":
            n["paths"] = tuple((p["path"], sql(p["condition"])) for p in n["paths"])
        if kind == "path":
            n["modules"] = tuple(registry.get_module(m) for m in n["modules"])
        g.add_node(name, spec(**{k: tuple(v) if isinstance(v, list) else v for k, v in n.items()}))
    for e in data.get("edges", []):
        g.add_edge(e["source"], e["target"], e.get("path"))
    return g.validate()
