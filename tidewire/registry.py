"""Modules by name: those registered here, and those that installed packages offer by entry points."""

from __future__ import annotations

from importlib import metadata

GROUPS = {"extractors": "tidewire.extractors", "fusions": "tidewire.fusions"}
_modules: dict[str, object] = {}


def register(module, name: str | None = None):
    _modules[name or module.name] = module
    return module


def discover(kind: str | None = None) -> dict[str, object]:
    """Entry points by name."""
    found = {}
    for k, group in GROUPS.items():
        if kind in (None, k):
            found |= {e.name: e for e in metadata.entry_points(group=group)}
    return found


def get_module(name: str):
    """A registered module, else the entry point's (made once, and kept)."""
    if name not in _modules:
        found = discover().get(name)
        if found is None:
            raise ValueError(f"no module {name!r}; known: {', '.join(list_modules()) or 'none'}")
        made = found.load()
        _modules[name] = made() if isinstance(made, type) else made
    return _modules[name]


get_extractor = get_fusion = get_module


def list_modules(kind: str | None = None) -> list[str]:
    return sorted({*(n for n, m in _modules.items() if kind is None or getattr(m, "kind", None) == kind), *discover(kind)})


def forget(name: str | None = None) -> None:
    if name is None:
        _modules.clear()
    else:
        _modules.pop(name, None)
