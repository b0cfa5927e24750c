"""Graphs of nodes: a logical plan on the driver, checked before it is compiled."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from . import specs as S


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    path_filter: str | None = None


class FlowGraph:
    """Nodes by name, edges with an optional path, and an entry: the first node unless another is named."""

    def __init__(self, entry: str | None = None):
        self.nodes: dict[str, S.Node] = {}
        self.edges: list[Edge] = []
        self.entry = entry
        self.callbacks: list[Callable] = []

    def add_node(self, name: str, spec: Any) -> FlowGraph:
        if name in self.nodes:
            raise ValueError(f"there already is a node {name!r}")
        self.nodes[name] = S.Node(name, spec)
        self.entry = self.entry or name
        return self

    def add_edge(self, source: str, target: str, path_filter: str | None = None) -> FlowGraph:
        for n in (source, target):
            if n not in self.nodes:
                raise ValueError(f"there is no node {n!r}")
        self.edges.append(Edge(source, target, path_filter))
        return self

    def on_trigger(self, callback: Callable) -> FlowGraph:
        self.callbacks.append(callback)
        return self

    def outgoing(self, name: str) -> list[Edge]:
        return [e for e in self.edges if e.source == name]

    def incoming(self, name: str) -> list[Edge]:
        return [e for e in self.edges if e.target == name]

    def successors(self, name: str, path_id: str | None = None) -> list[str]:
        """Targets of the edges that are open for a path."""
        return [e.target for e in self.outgoing(name) if e.path_filter is None or e.path_filter == path_id]

    def terminals(self) -> list[str]:
        return [n for n in self.nodes if not self.outgoing(n)]

    def topological(self) -> list[str]:
        """Every node after those it depends on; among equals, in the order they were added."""
        waiting = {n: len(self.incoming(n)) for n in self.nodes}
        ready, out = deque(n for n, k in waiting.items() if not k), []
        while ready:
            n = ready.popleft()
            out.append(n)
            for e in self.outgoing(n):
                waiting[e.target] -= 1
                if not waiting[e.target]:
                    ready.append(e.target)
        if len(out) < len(self.nodes):
            raise ValueError(f"the graph has a cycle through {sorted(set(self.nodes) - set(out))}")
        return out

    def ancestors(self, name: str) -> set[str]:
        found, todo = set(), [name]
        while todo:
            for e in self.incoming(todo.pop()):
                if e.source not in found:
                    found.add(e.source)
                    todo.append(e.source)
        return found

    def validate(self) -> FlowGraph:
        """An entry, no cycles, every node reachable, and every module's dependencies in its node or before it."""
        if not self.nodes or self.entry not in self.nodes:
            raise ValueError("the graph has no entry node")
        order = self.topological()
        reached, todo = {self.entry}, [self.entry]
        while todo:
            for e in self.outgoing(todo.pop()):
                if e.target not in reached:
                    reached.add(e.target)
                    todo.append(e.target)
        if lost := [n for n in order if n not in reached]:
            raise ValueError(f"nodes that cannot be reached from {self.entry!r}: {lost}")
        for n in order:
            have = {m.name for k in (*self.ancestors(n), n) for m in modules_of(self.nodes[k].spec)}
            for m in modules_of(self.nodes[n].spec):
                if missing := [d for d in m.depends if d not in have and d not in m.aliases.values() and m.aliases.get(d) not in have]:
                    raise ValueError(f"module {m.name!r} in node {n!r} depends on {missing}, which nothing before it gives")
        return self

    @classmethod
    def from_modules(cls, modules: list, name: str = "pipeline") -> FlowGraph:
        return cls().add_node("source", S.Source()).add_node(name, S.Modules(tuple(modules))).add_edge("source", name)

    @classmethod
    def from_pipeline(cls, extractors: list, fusion=None, name: str = "pipeline") -> FlowGraph:
        """The older form: extractors and one fusion."""
        return cls().add_node("source", S.Source()).add_node(name, S.Extract(tuple(extractors), fusion)).add_edge("source", name)

    def to_dot(self, title: str = "flow") -> str:
        """Graphviz text: a shape for each kind of node, edges labelled by their path."""
        shapes = {"Source": "ellipse", "Join": "invtriangle", "Branch": "diamond", "MultiBranch": "diamond", "FanOut": "triangle", "ConditionalFanOut": "triangle", "Modules": "box3d", "Extract": "box3d", "Collector": "folder"}
        q = lambda s: '"' + str(s).replace('"', '\\"') + '"'
        lines = [f"digraph {q(title)} {{", "  rankdir=LR;"]
        lines += [f"  {q(n)} [shape={shapes.get(type(x.spec).__name__, 'box')}, label={q(f'{n}: {type(x.spec).__name__}')}];" for n, x in self.nodes.items()]
        lines += [f"  {q(e.source)} -> {q(e.target)}" + (f" [label={q(e.path_filter)}]" if e.path_filter else "") + ";" for e in self.edges]
        return "\n".join([*lines, "}"])

    def to_ascii(self) -> str:
        """A tree from the entry; a node met again is marked (ref)."""
        out, seen = [], set()

        def walk(name: str, depth: int, label: str) -> None:
            mark = " (ref)" if name in seen else ""
            out.append("  " * depth + ("- " if depth else "") + (f"[{label}] " if label else "") + f"{name} <{type(self.nodes[name].spec).__name__}>{mark}")
            if name in seen:
                return
            seen.add(name)
            for e in self.outgoing(name):
                walk(e.target, depth + 1, e.path_filter or "")

        if self.entry:
            walk(self.entry, 0, "")
        return "\n".join(out)


def modules_of(spec: Any) -> tuple:
    if isinstance(spec, S.Modules):
        return spec.modules
    return spec.modules() if isinstance(spec, S.Extract) else ()


def dependency_groups(modules) -> list[list]:
    """Modules that depend on each other, directly or not, together; in the order of their first member."""
    group = {m.name: m.name for m in modules}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for m in modules:
        for d in m.depends:
            if d in group:
                a, b = root(m.name), root(d)
                group[max(a, b)] = min(a, b)
    out: dict[str, list] = {}
    for m in modules:
        out.setdefault(root(m.name), []).append(m)
    return list(out.values())
