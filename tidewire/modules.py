"""Modules: analyzers of frames, as Columns where they can be and as vectorised Python where they must.

Every module has ``name``, ``depends`` (names of modules whose observations it reads), ``aliases`` (a dependency that may stand in for a missing one)
and ``apply(df)``, which appends its observation, if any, to ``observations``, and to ``results`` if it fires. Null counts as no observation.
"""

from __future__ import annotations

import inspect
import time
import traceback
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import functions as fn
from . import registry
from .operators import fusion as _fusion
from .operators.ordered import arrow_schema
from .schema import OBS, WORKER_RESULT

#: Ways to run a module that callers may ask for; Spark runs Columns in the JVM and Python in worker processes whatever is named, so these are notes.
LEVELS = ("inline", "thread", "process", "venv", "container")


def isolation(wanted: str | None, recommended: str = "inline", override: str | None = None) -> str:
    """The override, else the stronger of what is wanted and recommended. Containers are the cluster's to give."""
    for level in (wanted, recommended, override):
        if level is not None and level.lower() not in LEVELS:
            raise ValueError(f"unknown isolation level {level!r}")
    level = override.lower() if override else max((wanted or "inline").lower(), recommended.lower(), key=LEVELS.index)
    if level == "container":
        raise NotImplementedError("run the executors in containers instead")
    return level


class Module:
    kind = "extractors"
    stateful = False

    def __init__(self, name: str, depends: tuple = (), aliases: dict | None = None):
        self.name, self.depends, self.aliases = name, tuple(depends), dict(aliases or {})

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def reset(self) -> None:
        """Modules keep no state on the driver."""


def _append(df: DataFrame, obs: Column) -> DataFrame:
    out = df.withColumn("_obs", obs)
    fires = F.col("_obs").isNotNull() & fn.fires(F.col("_obs"))
    return out.withColumns({
        "observations": F.when(F.col("_obs").isNotNull(), F.concat("observations", F.array("_obs"))).otherwise(F.col("observations")),
        "results": F.when(fires, F.concat("results", F.array("_obs"))).otherwise(F.col("results")),
    }).drop("_obs")


class ColumnModule(Module):
    """``build(deps)`` returns the observation as a Column; ``deps(name)`` is a dependency's observation, null if missing."""

    def __init__(self, name: str, build: Callable, depends: tuple = (), aliases: dict | None = None):
        super().__init__(name, depends, aliases)
        self.build = build

    def apply(self, df: DataFrame) -> DataFrame:
        found = fn.depends(F.col("observations"), list(self.depends), F.col("results"), self.aliases) if self.depends else None
        deps = (lambda n: F.try_element_at(found, F.lit(n))) if self.depends else (lambda n: F.lit(None).cast(OBS))
        return _append(df, self.build(deps) if inspect.signature(self.build).parameters else self.build())


def as_process(given) -> Callable:
    """A function of (frame, deps) from a function, or from an object with ``process``, ``extract`` or ``update``, in that order.

    ``update`` gets the first dependency's observation, and is not called where there is none.
    """
    for name in ("process", "extract"):
        if hasattr(given, name):
            return getattr(given, name)
    if hasattr(given, "update") and not inspect.isfunction(given):
        return lambda frame, deps: next((given.update(o) for o in deps.values()), None)
    if callable(given):
        return given
    raise TypeError(f"{given!r} is no function and has no process(), extract() or update()")


class PythonModule(Module):
    """``process(frame, deps)``, a function or an object that has one (see ``as_process``), is called for each row with dictionaries; it returns a dictionary of values, a whole observation, or None.

    ``init`` makes what the module needs once in each task (its result is passed as ``frame['context']``), ``cleanup`` ends it. Errors: ``raise``, or
    ``drop``, which gives no observation for the row. ``timeout_sec``: a call that takes longer counts as failed, and its late result is not
    waited for. The signature is looked at once, never tried.
    """

    def __init__(self, name: str, process: Callable, depends: tuple = (), aliases: dict | None = None, init: Callable | None = None, cleanup: Callable | None = None, reads: tuple = (), on_error: str = "raise", level: str = "inline", timeout_sec: float | None = None):
        super().__init__(name, depends, aliases)
        self.timeout_sec = timeout_sec
        self.process, self.init, self.cleanup, self.reads, self.on_error, self.level = as_process(process), init, cleanup, tuple(reads), on_error, isolation(level)

    def apply(self, df: DataFrame) -> DataFrame:
        return run_python([self], df)


class Caller:
    """Calls modules, those with a timeout in a thread of their own."""

    def __init__(self):
        self.pools: dict = {}

    def __call__(self, m: PythonModule, args: tuple):
        if m.timeout_sec is None:
            return m.process(*args)
        from concurrent.futures import ThreadPoolExecutor

        pool = self.pools.setdefault(m.name, ThreadPoolExecutor(1))
        try:
            return pool.submit(m.process, *args).result(m.timeout_sec)
        except TimeoutError:
            self.pools.pop(m.name).shutdown(wait=False)
            raise


def worker_results(module: PythonModule, df: DataFrame, out: str = "worker") -> DataFrame:
    """``df`` with struct(observation, error, timing_ms) for the module's call on each row: errors are values, and stop nothing."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{out} {WORKER_RESULT}").fields])
    names = df.columns
    need = list(dict.fromkeys(["frame_id", "t_ns", "observations", "results", *module.reads]))
    n = min(2, len(inspect.signature(module.process).parameters))

    def run(batches: Iterator[pa.RecordBatch]):
        kind = arrow_schema(schema).field(out).type
        call, context = Caller(), module.init() if module.init else None
        for b in batches:
            got = []
            for r in b.select(need).to_pylist():
                deps = {o["source"]: _plain(o) for o in [*r["observations"], *r["results"]] if o["source"] in module.depends}
                began, obs, error = time.perf_counter(), None, None
                try:
                    obs = as_observation(call(module, (r | {"context": context}, deps)[:n]), module.name, r)
                except Exception as e:  # noqa: BLE001  it is the row's result
                    error = f"{type(e).__name__}: {e}"
                got.append({"observation": _entries(obs) if obs else None, "error": error, "timing_ms": (time.perf_counter() - began) * 1e3})
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], [*names, out])

    return df.mapInArrow(run, schema)


def python_condition(test: Callable, reads: list[str], on_error: str = "raise"):
    """A condition from a Python function of a row's dictionary, for filters and branches that no Column expresses.

    It runs as a vectorised UDF, behind which no predicate is pushed. ``drop``: a row on which it fails counts as false.
    """

    def column(df: DataFrame) -> Column:
        def run(batches: Iterator) -> Iterator:
            for rows in batches:
                out = []
                for r in rows.to_dict("records"):
                    try:
                        out.append(bool(test(r)))
                    except Exception:
                        if on_error == "raise":
                            raise
                        out.append(False)
                import pandas as pd

                yield pd.Series(out, dtype=bool)

        from collections.abc import Iterator as It

        import pandas as pd

        run.__annotations__ = {"batches": It[pd.DataFrame], "return": It[pd.Series]}
        return F.pandas_udf(run, "boolean")(F.struct(*reads))

    return column


def as_observation(value, name: str, row: dict) -> dict | None:
    """A module's result as an observation: numbers and booleans become signals, other values JSON data."""
    import json

    if value is None:
        return None
    if "signals" in value and "source" in value:
        full = {"source": name, "frame_id": row["frame_id"], "t_ns": row["t_ns"], "signals": {}, "data": None, "metadata": {}, "timing": None, "trigger": None} | value
        full["signals"] = {k: float(v) for k, v in (full["signals"] or {}).items()}
        return full
    signals = {k: float(v) for k, v in value.items() if isinstance(v, (bool, int, float))}
    rest = {k: v for k, v in value.items() if not isinstance(v, (bool, int, float)) and k != "trigger"}
    return {"source": name, "frame_id": row["frame_id"], "t_ns": row["t_ns"], "signals": signals, "data": json.dumps(rest, default=str) if rest else None, "metadata": {}, "timing": None, "trigger": value.get("trigger")}


def _plain(obs: dict) -> dict:
    return {**obs, **{k: dict(obs[k]) for k in ("signals", "metadata", "timing") if isinstance(obs.get(k), list)}}


def run_python(modules: list[PythonModule], df: DataFrame, timing: bool = False) -> DataFrame:
    """A chain of Python modules in one pass: rows cross to Python once, modules are made ready once in each task."""
    names = df.columns
    need = list(dict.fromkeys(["frame_id", "t_ns", "observations", "results", *(c for m in modules for c in m.reads)]))
    schema = df.schema
    wants = [min(2, len(inspect.signature(m.process).parameters)) for m in modules]

    def run(batches: Iterator[pa.RecordBatch]):
        target = arrow_schema(schema)
        call = Caller()
        contexts = [m.init() if m.init else None for m in modules]
        try:
            for b in batches:
                rows = b.select(need).to_pylist()
                for r in rows:
                    deps = {o["source"]: _plain(o) for o in [*r["observations"], *r["results"]]}
                    for m, n, c in zip(modules, wants, contexts):
                        mine = {d: deps[d] for d in m.depends if d in deps} | {d: deps[a] for d, a in m.aliases.items() if d not in deps and a in deps}
                        began = time.perf_counter()
                        try:
                            got = as_observation(call(m, (r | {"context": c}, mine)[:n]), m.name, r)
                        except Exception:
                            if m.on_error == "raise":
                                raise RuntimeError(f"module {m.name!r} failed on frame {r['frame_id']}:\n{traceback.format_exc()}") from None
                            got = None
                        if got is None:
                            continue
                        if timing:
                            got["timing"] = {m.name: (time.perf_counter() - began) * 1e3}
                        deps[m.name] = got
                        r["observations"] = [*r["observations"], got]
                        if (got["trigger"] or {}).get("fire"):
                            r["results"] = [*r["results"], got]
                arrays = [b.column(i) for i in range(b.num_columns)]
                for c in ("observations", "results"):
                    t = target.field(c).type
                    arrays[names.index(c)] = pa.array([[_entries(o) for o in r[c]] for r in rows], t)
                yield pa.RecordBatch.from_arrays(arrays, names)
        finally:
            for m, c in zip(modules, contexts):
                if m.cleanup:
                    m.cleanup(c)

    return df.mapInArrow(run, schema)


def _entries(obs: dict) -> dict:
    return {**obs, **{k: list(obs[k].items()) for k in ("signals", "metadata", "timing") if isinstance(obs.get(k), dict)}}


class FusionModule(Module):
    """A decision over the latest observations of ``sources``, with a cool-down; see operators.fusion. ``gate_sources`` is kept as a note: no gate ever closes."""

    kind, stateful = "fusions", True

    def __init__(self, name: str, sources: list[str], decide: Callable, wait_sec: float = 2.0, pre_sec: float = 2.0, post_sec: float = 2.0, gate_sources: tuple = (), bucket_ns: int | None = None):
        super().__init__(name, tuple(sources))
        self.sources, self.decide, self.wait_sec, self.pre_sec, self.post_sec, self.gate_sources = list(sources), decide, wait_sec, pre_sec, post_sec, tuple(gate_sources)
        self.bucket_ns = bucket_ns

    @property
    def is_gate_open(self) -> bool:
        return True

    def apply(self, df: DataFrame) -> DataFrame:
        order = _fusion.BY_OBSERVATION if "observation_no" in df.columns else _fusion.ORDER
        return _fusion.fuse(df, self.name, self.sources, self.decide, self.wait_sec, self.pre_sec, self.post_sec, order, self.bucket_ns)


def extractor(name: str, depends: tuple = (), aliases: dict | None = None):
    """Decorator: a function of dependencies (or of nothing) that returns an observation Column."""
    return lambda f: registry.register(ColumnModule(name, f, depends, aliases))


def python_extractor(name: str, **options):
    """Decorator: a Python function of (frame, deps)."""
    return lambda f: registry.register(PythonModule(name, f, **options))


def fusion(sources: list[str], name: str | None = None, cooldown: float = 2.0, gate_sources: tuple = ()):
    """Decorator: a function of {source: latest observation} that returns ``decision(...)``."""
    return lambda f: registry.register(FusionModule(name or f.__name__, sources, f, cooldown, gate_sources=gate_sources))


def run_modules(df: DataFrame, modules, path_id: str | None = None) -> DataFrame:
    """Modules in their order; neighbouring Python modules share one pass. ``path_id`` renames the path, as a path node does."""
    held: list[PythonModule] = []

    def flush(x: DataFrame) -> DataFrame:
        out = run_python(list(held), x) if held else x
        held.clear()
        return out

    for m in modules:
        if isinstance(m, PythonModule):
            held.append(m)
        else:
            df = m.apply(flush(df))
    df = flush(df)
    return df if path_id is None else df.withColumn("path_id", F.lit(path_id))


class Path:
    """A named chain of modules with an optional fusion; ``run`` gives {path: rows} for several."""

    def __init__(self, name: str, extractors: list, fusion=None):
        self.name, self.extractors, self.fusion = name, list(extractors), fusion
        seen: set = set()
        for m in self.extractors:
            if missing := [d for d in m.depends if d not in seen]:
                raise ValueError(f"{m.name!r} depends on {missing}, which come later or not at all")
            seen.add(m.name)

    def dependency_graph(self) -> dict[str, list[str]]:
        return {m.name: list(m.depends) for m in self.extractors}

    def extract_all(self, df: DataFrame) -> DataFrame:
        return run_modules(df, self.extractors, self.name)

    def process(self, df: DataFrame) -> DataFrame:
        """All of the fusion's outputs, firing or not; none without a fusion."""
        out = self.extract_all(df)
        if self.fusion is None:
            return out.limit(0)
        return self.fusion.apply(_fusion.explode_observations(out)).drop("observation_no")


def process_paths(paths: list[Path], df: DataFrame) -> dict[str, DataFrame]:
    return {p.name: p.process(df) for p in paths}


def extract_paths(paths: list[Path], df: DataFrame) -> DataFrame:
    """Every path's rows, as one."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.extract_all(df) for p in paths])


def python_processor(process: Callable, schema=None, on_error: str = "raise"):
    """A custom node from a Python function of a row's dictionary that returns a dictionary, a list of them, or None.

    ``schema``: that of what it returns (default: the input's). ``drop``: a row on which it fails gives nothing.
    """

    def apply(df: DataFrame) -> DataFrame:
        target_schema = df.schema if schema is None else schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

        def run(batches: Iterator[pa.RecordBatch]):
            target = arrow_schema(target_schema)
            for b in batches:
                out: list[dict] = []
                for r in b.to_pylist():
                    try:
                        got = process(r)
                    except Exception:
                        if on_error == "raise":
                            raise
                        continue
                    out += got if isinstance(got, list) else [] if got is None else [got]
                yield pa.RecordBatch.from_pylist(out, target)

        return df.mapInArrow(run, target_schema)

    return apply


def detection_udf(detect: Callable, init: Callable | None = None):
    """A vectorised UDF from image bytes to an array of detections; ``init`` loads the model once in each worker."""
    from .schema import DETECTION

    held: list = []
    kind = arrow_schema(f"x array<{DETECTION}>").field("x").type

    def run(images: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if init and not held:
            held.append(init())
        for a in images:
            yield pa.array([None if x is None else [d | {"metadata": list((d.get("metadata") or {}).items())} for d in (detect(x, held[0]) if held else detect(x))] for x in a.to_pylist()], kind)

    return F.arrow_udf(run, f"array<{DETECTION}>") if hasattr(F, "arrow_udf") else F.pandas_udf(run, f"array<{DETECTION}>")
