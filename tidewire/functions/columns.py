"""Column functions: observations, triggers, comparisons, units and message codecs. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MS, NS, OBS, TRIGGER

COMPARISONS = ("gt", "ge", "lt", "le", "eq", "ne")


def compare(value: Column, comparison: str, threshold: float) -> Column:
    """value <comparison> threshold as IEEE numbers compare: NaN is never over, under or equal to anything, and differs from all."""
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}; one of {', '.join(COMPARISONS)}")
    if threshold != threshold:
        raise ValueError("a threshold cannot be NaN")
    t, number = F.lit(float(threshold)), ~F.isnan(value)
    return {
        "gt": lambda: (value > t) & number,
        "ge": lambda: (value >= t) & number,
        "lt": lambda: value < t,
        "le": lambda: value <= t,
        "eq": lambda: (value == t) & number,
        "ne": lambda: (value != t) | F.isnan(value),
    }[comparison]()


def sec_to_ns(x: Column) -> Column:
    """Seconds to whole nanoseconds, cut towards zero."""
    return (x * float(NS)).cast("bigint")


def ms_to_ns(x: Column) -> Column:
    return (x * float(MS)).cast("bigint")


def ns_to_ms(x: Column) -> Column:
    return x / F.lit(float(MS))


def get(m: Column, key: str, default) -> Column:
    """A map's value, or a default where the map or the key is missing."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def observation(source, frame_id=None, t_ns=None, signals: Column | None = None, data: Column | None = None, metadata: Column | None = None, timing: Column | None = None, trigger: Column | None = None) -> Column:
    """An observation struct; frame id and time are the row's unless given."""
    empty = F.expr("map()")
    return F.struct(
        (source if isinstance(source, Column) else F.lit(source)).alias("source"),
        (F.col("frame_id") if frame_id is None else frame_id).cast("bigint").alias("frame_id"),
        (F.col("t_ns") if t_ns is None else t_ns).cast("bigint").alias("t_ns"),
        (empty if signals is None else signals).cast("map<string,double>").alias("signals"),
        (F.lit(None) if data is None else data).cast("string").alias("data"),
        (empty if metadata is None else metadata).cast("map<string,string>").alias("metadata"),
        (F.lit(None) if timing is None else timing).cast("map<string,double>").alias("timing"),
        (F.lit(None) if trigger is None else trigger).cast(TRIGGER).alias("trigger"),
    ).cast(OBS)


def signals(**values: Column) -> Column:
    """A map of numbers; booleans count 1 and 0, nulls are left out."""
    entries = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def split_values(scalars: dict[str, Column], others: dict[str, Column], source: str) -> Column:
    """An analyzer's dictionary as an observation: numbers and booleans are signals, all else JSON data; null if all are null."""
    every = [*scalars.values(), *others.values()]
    some = F.lit(False)
    for v in every:
        some = some | v.isNotNull()
    data = F.when(F.size(F.array_compact(F.array(*[F.to_json(F.struct(v.alias(k))) for k, v in others.items()]))) > 0, F.to_json(F.struct(*[v.alias(k) for k, v in others.items()]))) if others else None
    return F.when(some, observation(source, signals=signals(**scalars) if scalars else None, data=data))


def merged(obs: Column) -> Column:
    """An observation as one map of strings: its signals, over which a JSON object's fields win; other data is under ``data``."""
    fields = F.from_json(obs["data"], "map<string,string>")
    plain = F.map_from_entries(F.transform(F.map_entries(obs["signals"]), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("string").alias("value"))))
    kept = F.map_filter(plain, lambda k, _: ~F.coalesce(F.map_contains_key(fields, k), F.lit(False)))
    extra = F.when(fields.isNotNull(), fields).when(obs["data"].isNotNull(), F.create_map(F.lit("data"), obs["data"])).otherwise(F.expr("cast(map() as map<string,string>)"))
    return F.map_concat(F.coalesce(kept, F.expr("cast(map() as map<string,string>)")), extra)


def depends(observations: Column, names: list[str], results: Column | None = None, aliases: dict[str, str] | None = None) -> Column:
    """Map of the named sources' observations; later ones of the same source win, results over observations, missing ones are left out.

    ``aliases``: a name to another source that stands in where the name is missing.
    """
    every = observations if results is None else F.concat(observations, results)

    def found(name):
        return F.try_element_at(F.filter(every, lambda o: o["source"] == name), F.lit(-1))

    pairs = []
    for n in names:
        x = found(n)
        if aliases and n in aliases:
            x = F.coalesce(x, found(aliases[n]))
        pairs.append(F.when(x.isNotNull(), F.struct(F.lit(n).alias("key"), x.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def fires(obs: Column) -> Column:
    return F.coalesce(obs["trigger"]["fire"], F.lit(False))


def trigger_score(obs: Column) -> Column:
    return F.coalesce(obs["trigger"]["score"], F.lit(0.0))


def trigger_reason(obs: Column) -> Column:
    return F.coalesce(obs["trigger"]["reason"], F.lit(""))


def trigger(reason, score=1.0, fire: Column | None = None, t_ns: Column | None = None, label=None, pre_sec: float = 2.0, post_sec: float = 2.0) -> Column:
    """A trigger struct: a point in time with a clip from ``pre_sec`` before it to ``post_sec`` after."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    t = F.col("t_ns") if t_ns is None else t_ns
    return F.struct(
        (F.lit(True) if fire is None else fire).alias("fire"), col(score).cast("double").alias("score"), col(reason).cast("string").alias("reason"), F.coalesce(col(label), col(reason)).cast("string").alias("label"),
        t.cast("bigint").alias("event_ns"), (t - int(pre_sec * NS)).cast("bigint").alias("clip_start_ns"), (t + int(post_sec * NS)).cast("bigint").alias("clip_end_ns"),
    ).cast(TRIGGER)


def label_or(label: Column, default: str = "HIGHLIGHT") -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), F.lit(default))


def first_ids(ids: Column, n: int = 5) -> Column:
    """The first n ids joined by commas, and how many more there are."""
    head = F.array_join(F.slice(ids.cast("array<string>"), 1, n), ", ")
    return F.when(F.size(ids) > n, F.concat(head, F.lit(" +"), (F.size(ids) - n).cast("string"), F.lit(" more"))).otherwise(head)


def to_message(obs: Column) -> Column:
    """An observation as JSON; empty timing and null data are left out."""
    slim = F.struct(
        obs["source"].alias("source"), obs["frame_id"].alias("frame_id"), obs["t_ns"].alias("t_ns"), obs["signals"].alias("signals"), obs["metadata"].alias("metadata"),
        F.when(F.size(obs["timing"]) > 0, obs["timing"]).alias("timing"), obs["data"].alias("data"), obs["trigger"].alias("trigger"),
    )
    return F.to_json(slim)


def from_message(message: Column) -> Column:
    """JSON to an observation; null if it is no JSON object with a source. The message is parsed once, then its fields are taken."""

    def full(o):
        signals_, metadata = F.coalesce(o["signals"], F.expr("cast(map() as map<string,double>)")), F.coalesce(o["metadata"], F.expr("cast(map() as map<string,string>)"))
        return F.when(o["source"].isNotNull(), observation(o["source"], o["frame_id"], o["t_ns"], signals_, o["data"], metadata, o["timing"], o["trigger"]))

    return F.get(F.transform(F.array(F.from_json(message, OBS, {"mode": "PERMISSIVE"})), full), F.lit(0))


def header(message: Column) -> Column:
    """(frame_id, source, t_ns) of a message, JSON (``source``, ``frame_id``, ``t_ns``) or ``OBS src=... frame=... t_ns=...``; (null, null, 0) if it is neither.

    Missing keys are 0, ``unknown`` and 0; of repeated keys the last counts; a number that cannot be read makes the message unreadable.
    """
    text = message
    parts = F.split(text, r"\s+")
    value = lambda key: F.substring_index(F.try_element_at(F.filter(parts, lambda p: p.startswith(f"{key}=")), F.lit(-1)), f"{key}=", -1)
    raw = lambda key, path: F.when(text.startswith("OBS "), value(key)).otherwise(F.get_json_object(text, path))
    frame, source, t = raw("frame", "$.frame_id"), raw("src", "$.source"), raw("t_ns", "$.t_ns")
    number = lambda x: F.coalesce(x, F.lit("0")).try_cast("bigint")
    is_json = text.startswith("{") & F.get_json_object(text, "$").isNotNull()
    ok = (text.startswith("OBS ") | is_json) & number(frame).isNotNull() & number(t).isNotNull()
    return F.struct(
        F.when(ok, number(frame)).alias("frame_id"), F.when(ok, F.coalesce(source, F.lit("unknown"))).alias("source"), F.coalesce(F.when(ok, number(t)), F.lit(0).cast("bigint")).alias("t_ns")
    )


def first_parsed(message: Column, *parsers) -> Column:
    """The first parser's result that is not null."""
    return F.coalesce(*[p(message) for p in parsers])


def encode_image(payload: Column) -> Column:
    return F.base64(payload)


def decode_image(text: Column) -> Column:
    return F.unbase64(text)


def event_time(t_ns: Column) -> Column:
    """A timestamp for watermarks; nanoseconds under a microsecond are cut."""
    return F.timestamp_micros(F.floor(t_ns / 1000).cast("bigint"))


def p95(values: Column) -> Column:
    """sorted[min(int(n * 0.95), n - 1)] of an array, 0.0 if it is empty."""
    s = F.sort_array(values)
    n = F.size(s)
    return F.when(n > 0, F.element_at(s, F.least((n * F.lit(0.95)).cast("int"), n - 1) + 1)).otherwise(F.lit(0.0))


def ema(values: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an array in its order; null if it is empty."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(x * alpha + a * (1 - alpha)))
