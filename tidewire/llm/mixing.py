"""Mixing sources to target weights: token weights are raked to source, language and topic marginals, then documents sampled.

Iterative proportional fitting over the cells (source, language, topic) of token counts: each pass scales the cells so that one
dimension's shares meet its targets, until all are met. A document's probability is its cell's factor over a scale, at most 1, so the
sample's tokens have the target shares in expectation and no document is repeated; ``keep`` lowers all alike. The scale is the largest
factor, but for cells that together hold under ``CLIP`` of the tokens: a tiny cell of a high factor is kept whole rather than made to lower all
others. ``report`` gives each value's share before, its target and its expected share after, so that a target that could not be met shows.
A document is kept if a number made from its id's hash is under its probability, so a retry or another partitioning keeps the same documents.

The topic is a column of the caller's, or is made from the texts: spherical k-means over hashed words, weighted 1 + ln tf and ln idf,
less the mean of the document's language, so that topics are not languages again. Every document with a word counts in the idf, the means, the choice
of the first centres and each round of the centres; then each goes to its nearest centre. Words are cut once, for the table of bags that all passes read and
that numbers of tokens and topics come from; and once more if the result has the texts themselves, which that table doesn't hold.

Null values of a dimension are a value of their own. Texts that are null, or have no word, count no token: their documents have their
cell's probability (1 where the cell counts none), and the topic of an empty text is ``none``. Rows that repeat an id are kept or dropped together.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text
from ._shared import drop, session, table

DIMS = ("source", "lang", "topic")
TOLERANCE, ROUNDS = 1e-9, 200
#: Exponent on the observed shares that gives the default targets: under 1, rare values are raised.
TEMPERATURE = 0.9
#: Cells that the driver rakes; more are raked by joins on the executors.
MAX_CELLS = 200_000


#: Share of tokens whose cells may have a probability under what their factor asks for, as that would be over 1.
CLIP = 0.01
#: Topics, and hashed words.
TOPICS, PLACES = 12, 1 << 12
#: Languages that have a mean of their own in the topic model: those of most documents. All others, and null, have one in common.
LANGUAGES = 64
#: Steps of a document's weights and of centres, of means, and of 1 / length of what a mean leaves. All are whole numbers, so sums and products are
#: exact, and topics the same whatever the partitions. Products of vectors of length 1 stay under the 2^24 that a float counts to.
STEP, FINE, PULL = 4000, 1 << 20, 1 << 12
#: Documents this near to their language's mean have no direction, and pull no centre.
NEAR = 0.01


#: Texts whose places are laid out at once for products.
LAID = 64
#: Places of the texts that share a row of the table of bags: few, as a batch of rows is held whole.
PACK = 4096
#: Rows that are worked on at once: what is made of them stays in a CPU's cache.
ROWS = 32
#: Texts of least waiting time that are fetched for each first centre. Where they can't show that no other comes before, all texts are asked.
SOONEST = 256


def _dots(b: _Bags, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products of the texts' weights with each row."""
    out, by = np.zeros((len(b.size), len(rows)), np.float32), np.ascontiguousarray(rows.T, np.float32)
    laid, at, x, end = np.zeros(LAID * PLACES, np.float32), b.at + np.repeat(np.arange(len(out)) % LAID * PLACES, b.size), x.astype(np.float32), b.cut + b.size
    for i in range(0, len(out), LAID):
        j = min(i + LAID, len(out))
        some = slice(b.cut[i], end[j - 1])
        laid[at[some]] = x[some]
        out[i:j] = laid.reshape(LAID, PLACES)[: j - i] @ by
        laid[at[some]] = 0
    return out.astype(float)


def _whole(v: np.ndarray) -> np.ndarray:
    """Rows made of length 1, in steps."""
    return np.rint(v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12) * STEP)


def _binary(x: np.ndarray, off: np.ndarray) -> pa.Array:
    """Parts of ``x`` as binary values, which begin (and end) at ``off``."""
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


class _Bags:
    """Texts with words as (``key``, ``lang``, places ``at``, ``value`` of each, ``pull``); each text's places begin at ``cut``.

    A row of a table holds several texts: each column has their values one after another, ``size`` how many places each has.
    """

    COLUMNS = ("key", "lang", "size", "at", "value", "pull")
    SCHEMA = ", ".join(f"{c} binary" for c in COLUMNS)

    def __init__(self, key, lang, at, size, value, pull):
        self.key, self.lang, self.at, self.size, self.value, self.pull = key, lang, at, size, value, pull
        self.cut = np.cumsum(size) - size

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def columns(self, rows: np.ndarray, kind=np.uint16) -> list[pa.Array]:
        """``rows``: the text that each row begins with, and the end. ``kind``: of the values; weights are small, counts need not be."""
        places = np.append(self.cut, len(self.at))[rows]
        each = [(self.key, np.int64, rows), (self.lang, np.uint8, rows), (self.size, np.uint16, rows), (self.at, np.uint16, places), (self.value, kind, places), (self.pull, np.int32, rows)]
        return [_binary(x.astype(k), off) for x, k, off in each]

    @classmethod
    def of(cls, b: pa.RecordBatch, kind=np.uint16) -> _Bags:
        kinds = (np.int64, np.uint8, np.uint16, np.uint16, kind, np.int32)
        key, lang, size, at, value, pull = (_text.buffers(b.column(c))[0].view(k) for c, k in zip(cls.COLUMNS, kinds))
        return cls(key, lang.astype(np.int64), at.astype(np.int64), size.astype(np.int64), value.astype(float), pull.astype(np.int64))

    @classmethod
    def read(cls, batches, kind=np.uint16):
        """Batches in pieces that are worked on at once, with their texts."""
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                yield (s := b.slice(i, ROWS)), cls.of(s, kind)

    def some(self, which: np.ndarray) -> _Bags:
        size = self.size[which]
        at = np.repeat(self.cut[which] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return _Bags(self.key[which], self.lang[which], self.at[at], size, self.value[at], self.pull[which])


class _Here:
    """Bags held in this process, for what ``_Spread`` does on the executors."""

    def __init__(self, bags: _Bags):
        self.bags = bags

    def total(self, f, size: int) -> np.ndarray:
        return f(self.bags).astype(np.int64)

    def soonest(self, seeds: list[int], many: int) -> list[tuple[_Bags, float]]:
        return [(self.bags, np.inf) for _ in seeds]

    def least(self, cost) -> _Bags | None:
        return _least(self.bags, cost(self.bags))

    def map(self, f) -> _Here:
        return _Here(f(self.bags))

    def drop(self) -> None:
        pass


def _least(b: _Bags, cost: np.ndarray) -> _Bags | None:
    """The text of least cost, of these that of least key; none if all are infinite."""
    if not len(cost) or cost.min() == np.inf:
        return None
    tied = np.flatnonzero(cost == cost.min())
    return b.some(tied[b.key[tied].argmin()][None])


def _first(wait: np.ndarray, key: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the ``many`` least waiting times, each key once."""
    order = np.lexsort((key, wait))
    order = order[np.diff(key[order], prepend=~key[order[:1]]) != 0][:many]
    return wait[order], key[order]


class _Spread:
    """Bags as a table in the shared folder. Passes return sums, or one row of each task, so that nothing grows with the corpus but the passes."""

    def __init__(self, rows: DataFrame, kind=np.uint16, codec: str = "zstd"):
        self.rows, self.kind = table(rows, "bags", codec), kind
        self.bags = self.rows.select(*_Bags.COLUMNS)

    def total(self, f, size: int) -> np.ndarray:
        """The sum of ``f`` (``size`` whole numbers, none negative) over all batches."""
        chunks, step, kind = -(-size // _text.CHUNK), _text.CHUNK, self.kind

        @_text.tidy
        def add(batches):
            s = np.zeros(chunks * step, np.int64)
            for _, b in _Bags.read(batches, kind):
                s[:size] += f(b).astype(np.int64)
            for c in range(chunks):
                if (x := s[c * step : (c + 1) * step]).any():
                    yield pa.record_batch({"chunk": pa.array([c], pa.int32()), "data": pa.array([_text.pack(x)], pa.binary())})

        out = np.zeros(chunks * step, np.int64)
        for r in _text.sum_chunks(self.bags.mapInArrow(add, "chunk int, data binary"), chunks).collect():
            out[r.chunk * step : (r.chunk + 1) * step] = _text.unpack(bytes(r.data))
        return out[:size]

    def soonest(self, seeds: list[int], many: int) -> list[tuple[_Bags, float]]:
        """For each seed ``many`` texts, by key, of least waiting time among those that have a direction, and the time that no other comes before."""

        def rows(found):
            for n, (wait, key) in found.items():
                yield pa.record_batch({"n": pa.array([n], pa.int32()), "wait": pa.array([wait.tobytes()], pa.binary()), "key": pa.array([key.tobytes()], pa.binary())})

        none = np.zeros(0), np.zeros(0, np.int64)

        @_text.tidy
        def find(batches):
            found: dict = {}
            for b in batches:
                far = _text.buffers(b.column("pull"))[0].view(np.int32) > 0
                keys = _text.buffers(b.column("key"))[0].view(np.int64)[far]
                for n, seed in enumerate(seeds if len(keys) else ()):
                    had, wait = found.get(n, none), _wait(keys, seed)
                    new = wait <= had[0][-1] if len(had[0]) == many else slice(None)
                    found[n] = _first(np.append(had[0], wait[new]), np.append(had[1], keys[new]), many)
            yield from rows(found)

        @_text.tidy
        def merge(batches):
            found: dict = {}
            for b in batches:
                for n, *each in zip(*(c.to_pylist() for c in b.columns)):
                    found[n] = _first(*(np.append(had, np.frombuffer(x, had.dtype)) for had, x in zip(found.get(n, none), each)), many)
            yield from rows(found)

        schema = "n int, wait binary, key binary"
        parts = self.rows.select("pull", "key").mapInArrow(find, schema).repartition(len(seeds), "n")
        found = {r.n: (np.frombuffer(bytes(r.wait)), np.frombuffer(bytes(r.key), np.int64)) for r in parts.mapInArrow(merge, schema).collect()}
        want = np.unique(np.concatenate([none[1], *(key for _, key in found.values())]))

        @_text.tidy
        def fetch(batches):
            had = np.zeros(0, np.int64)
            for _, b in _Bags.read(batches):
                if (hit := np.isin(b.key, want)).any():
                    at = np.flatnonzero(hit)[np.unique(b.key[hit], return_index=True)[1]]
                    b = b.some(at[~np.isin(b.key[at], had)])
                    had = np.append(had, b.key)
                    yield pa.RecordBatch.from_arrays(b.columns(np.arange(len(b.key) + 1)), _Bags.COLUMNS)

        got = self.bags.mapInArrow(fetch, _Bags.SCHEMA).dropDuplicates(["key"]).collect() if len(want) else []
        all_ = _Bags.of(pa.record_batch({c: pa.array([bytes(r[c]) for r in got], pa.binary()) for c in _Bags.COLUMNS}))
        return [(all_.some(np.flatnonzero(np.isin(all_.key, key))), wait[-1] if len(wait) == many else np.inf) for wait, key in (found.get(n, none) for n in range(len(seeds)))]

    def least(self, cost) -> _Bags | None:
        """The text of least cost of all, whose values are weights; none if all are infinite."""

        @_text.tidy
        def find(batches):
            best, row = (np.inf, 0), None
            for _, b in _Bags.read(batches):
                c = cost(b)
                if (one := _least(b, c)) is not None and (c.min(), one.key[0]) < best:
                    best, row = (c.min(), one.key[0]), one
            if row is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]], pa.int64()), *row.columns(np.array([0, 1]))], ["cost", "of", *_Bags.COLUMNS])

        r = self.bags.mapInArrow(find, f"cost double, of long, {_Bags.SCHEMA}").orderBy("cost", "of").first()
        return None if r is None else _Bags.of(pa.record_batch({c: pa.array([bytes(r[c])], pa.binary()) for c in _Bags.COLUMNS}))

    def map(self, f) -> _Spread:
        """What ``f`` makes of values and pulls, weights for values. Other columns stay."""
        kind = self.kind

        @_text.tidy
        def run(batches):
            for s, b in _Bags.read(batches, kind):
                new = f(b)
                made = {"value": _binary(new.value.astype(np.uint16), _text.buffers(s.column("at"))[1] // 2), "pull": _binary(new.pull.astype(np.int32), _text.buffers(s.column("key"))[1] // 8)}
                yield pa.RecordBatch.from_arrays([made.get(c, s.column(c)) for c in s.schema.names], s.schema.names)

        return _Spread(self.rows.mapInArrow(run, self.rows.schema), codec="none")  # read many times

    def drop(self) -> None:
        drop(self.rows)


class Topics:
    """Centres of topics over hashed words. ``of`` gives texts their number of words and the number of their topic, -1 without words."""

    def __init__(self, k: int = TOPICS):
        self.k, self.idf, self.centres = k, np.ones(PLACES), np.zeros((1, PLACES))
        self.languages: dict[str, int] = {}
        self.shift = np.zeros((1, 1))  # each language's mean times each centre; the last row is for other languages

    def bags(self, texts: pa.Array, langs: list, keys: np.ndarray) -> tuple[np.ndarray, _Bags]:
        """Words of each text; those that have words, with their distinct hashed words and how often each comes."""
        w = _text.Words(texts, lower=True)
        place = np.sort(w.doc * PLACES + (w.h % np.uint64(PLACES)).astype(np.int64))
        new = np.flatnonzero(np.diff(place, prepend=-1))
        (doc, at), tf = np.divmod(place[new], PLACES), np.diff(new, append=len(place))
        words = np.diff(w.off)
        has = words > 0
        lang = np.array([len(self.languages) if v is None else self.languages.get(str(v), len(self.languages)) for v in langs], int)
        return words, _Bags(keys[has], lang[has], at, np.bincount(doc, minlength=len(texts))[has], tf, np.zeros(has.sum(), int))

    def weights(self, b: _Bags) -> np.ndarray:
        """Weights of each text's words, together of length 1, in steps of STEP."""
        x, doc = (1 + np.log(b.value)) * self.idf[b.at], b.doc
        return np.rint(x / np.maximum(np.sqrt(np.bincount(doc, x * x, len(b.size))), 1e-12)[doc] * STEP)

    def fit(self, texts: pa.Array, langs: list, rounds: int = 20, seed: int = 5) -> Topics:
        """Centres from texts that are held here."""
        self.know(Counter(str(v) for v in langs if v is not None))
        self.learn(_Here(self.bags(texts, langs, np.arange(len(texts)))[1]), rounds, seed)
        return self

    def know(self, count: dict) -> None:
        self.languages = {v: i for i, v in enumerate(sorted(count, key=lambda v: (-count[v], v))[:LANGUAGES])}

    def learn(self, docs: _Here | _Spread, rounds: int = 20, seed: int = 5) -> _Here | _Spread:
        """Every document counts in the words' idf, in its language's mean, as a first centre and in each round's centres. ``docs`` is dropped; returns its weights."""
        last = len(self.languages) + 1
        df = docs.total(lambda b: np.append(np.bincount(b.at, minlength=PLACES), len(b.size)), PLACES + 1)
        self.idf = np.log((df[-1] + 1) / (df[:-1] + 1))
        weights = self.weights
        sums = docs.total(lambda b: np.append(np.bincount(b.at + PLACES * b.lang[b.doc], weights(b), last * PLACES), np.bincount(b.lang, minlength=last)), last * (PLACES + 1))
        of_lang = np.maximum(sums[last * PLACES :], 1)[:, None]
        mean = np.rint(sums[: last * PLACES].reshape(last, PLACES) / of_lang / STEP * FINE)
        size = (mean * mean).sum(1) / FINE**2

        def weigh(b: _Bags) -> _Bags:
            x = weights(b)
            far = np.add.reduceat(x * x, b.cut) / STEP**2 - 2 * np.add.reduceat(mean[b.lang[b.doc], b.at] * x, b.cut) / (STEP * FINE) + size[b.lang] if len(b.size) else np.zeros(0)
            far = np.sqrt(np.maximum(far, 0))
            return _Bags(b.key, b.lang, b.at, b.size, x, np.where(far > NEAR, np.rint(PULL / np.maximum(far, NEAR)), 0).astype(int))

        bags = docs.map(weigh)
        docs.drop()
        centres, seeds = np.zeros((0, PLACES)), [seed + 1000 * n for n in range(self.k)]
        for s, (few, late) in zip(seeds, bags.soonest(seeds, SOONEST)):  # far from those chosen, by chance: the least of exponential times at these rates
            cost = _chance(centres, mean @ centres.T, s)
            one, most = _least(few, c := cost(few)), (1 + 1.01 * np.sqrt((centres**2).sum(1).max(initial=0)) / STEP) ** 2
            if late < np.inf and not c.min() < late / most:  # a text that isn't here has a rate of ``most`` at most
                one = bags.least(cost)
            if one is None:
                break
            v = -mean[one.lang[0]] / FINE
            v[one.at] += one.value / STEP
            centres = np.concatenate([centres, _whole(v[None])])
        k, was = len(centres), None
        for _ in range(rounds if k else 0):
            sums = bags.total(_pulls(centres, mean @ centres.T), k * (PLACES + last))
            if was is not None and np.array_equal(sums, was):
                break
            was = sums
            pull = sums[k * PLACES :].reshape(k, last)
            new = _whole(sums[: k * PLACES].reshape(k, PLACES) / STEP - pull @ (mean / FINE))
            centres = np.where(pull.sum(1, keepdims=True) > 0, new, centres)
        self.centres = centres if k else np.zeros((1, PLACES))
        self.shift = mean @ self.centres.T
        return bags

    def of(self, texts: pa.Array, langs: list) -> tuple[np.ndarray, np.ndarray]:
        words, b = self.bags(texts, langs, np.arange(len(texts)))
        topic = np.full(len(texts), -1)
        topic[b.key] = _like(b, self.weights(b), self.centres, self.shift).argmax(1)
        return words, topic


def _like(b: _Bags, x: np.ndarray, centres: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """What the mean of its language leaves of each text, times each centre."""
    return _dots(b, x, centres) / STEP**2 - shift[b.lang] / (FINE * STEP)


def _chance(centres: np.ndarray, shift: np.ndarray, seed: int):
    """A text's waiting time, by its key; the rate is its squared distance from the centres, as k-means++ has it."""

    def cost(b: _Bags) -> np.ndarray:
        far = (b.pull > 0).astype(float)
        if len(centres):
            far *= np.maximum(1 - (_like(b, b.value, centres, shift) * (b.pull / PULL)[:, None]).max(1), 0) ** 2
            far[far < 1e-6] = 0  # a copy of a centre, but for rounding
        return np.divide(_wait(b.key, seed), far, out=np.full(len(far), np.inf), where=far > 0)

    return cost


def _wait(key: np.ndarray, seed: int) -> np.ndarray:
    """Exponential times by key, at rate 1."""
    u = ((_text.mix(key.astype(np.int64).view(np.uint64) ^ _text.mix(np.array([seed], np.uint64))) >> np.uint64(11)) + 0.5) / 2.0**53
    return -np.log(u)


def _pulls(centres: np.ndarray, shift: np.ndarray):
    """For each centre, the sum of its nearest texts' weights over their lengths, and of each language's 1 / length."""
    k, last = len(centres), len(shift)

    def sums(b: _Bags) -> np.ndarray:
        of = _like(b, b.value, centres, shift).argmax(1)
        words = np.bincount(b.at + np.repeat(of * PLACES, b.size), b.value * np.repeat(b.pull, b.size), k * PLACES)
        return np.append(words, np.bincount(of * last + b.lang, b.pull, k * last))

    return sums


def fit_topics(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> Topics:
    """Topics of ``docs``, from all of them."""
    model, bags = _learn(docs, id_col, text_col, lang_col)
    bags.drop()
    return model


def _learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, columns: list = ()) -> tuple[Topics, _Spread]:
    """Topics of ``docs``, and the table of weights. Its column ``texts`` has for each text of a row ``row`` (``columns``; if none, the id) and ``tokens``, texts without words last."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    model = Topics()
    if lang_col:
        model.know({r.lang: r.n for r in docs.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).where("lang is not null").orderBy(F.col("n").desc(), "lang").limit(LANGUAGES).collect()})
    src = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), lang).alias("key"), lang.alias("lang"), F.col(text_col).cast("string").alias("text"), F.struct(*_columns(docs, columns or [id_col])).alias("row"))
    text = T.StructType([src.schema["row"], T.StructField("tokens", T.LongType())])
    schema = T.StructType([T.StructField("texts", T.ArrayType(text)), *[T.StructField(c, T.BinaryType()) for c in _Bags.COLUMNS]])

    @_text.tidy
    def read(batches):
        for batch in batches:
            for s in _text.slices(batch):
                words, bags = model.bags(s.column("text").cast(pa.string()), s.column("lang").to_pylist(), s.column("key").to_numpy())
                order = np.argsort(words == 0, kind="stable")
                begin = np.flatnonzero(np.diff((bags.cut + 8 * np.arange(len(bags.size))) // PACK, prepend=-1)) if len(bags.size) else np.zeros(1, np.int64)
                texts = pa.StructArray.from_arrays([s.column("row"), pa.array(words, pa.int64())], ["row", "tokens"]).take(pa.array(order))
                texts = pa.ListArray.from_arrays(pa.array(np.append(begin, len(words)), pa.int32()), texts)
                yield pa.RecordBatch.from_arrays([texts, *bags.columns(np.append(begin, len(bags.size)), np.uint32)], schema.names)

    return model, model.learn(_Spread(src.mapInArrow(read, schema), np.uint32))


def _found(model: Topics, bags: _Spread) -> DataFrame:
    """(row, tokens, topic) of each text of ``bags``, as a table; ``bags`` is dropped."""

    @_text.tidy
    def run(batches):
        for s, b in _Bags.read(batches):
            texts, of = s.column("texts"), np.full(len(s.column("texts").flatten()), -1)
            have = np.diff(_text.buffers(s.column("key"))[1]) // 8
            at = np.cumsum(texts.value_lengths().to_numpy()) - texts.value_lengths().to_numpy()
            of[np.repeat(at - (np.cumsum(have) - have), have) + np.arange(len(b.size))] = _like(b, b.value, model.centres, model.shift).argmax(1)
            row, tokens = texts.flatten().flatten()
            yield pa.RecordBatch.from_arrays([row, tokens, pa.array([_name(k) for k in of.tolist()], pa.string())], ["row", "tokens", "topic"])

    one = bags.rows.schema["texts"].dataType.elementType
    out = table(bags.rows.mapInArrow(run, T.StructType([*one.fields, T.StructField("topic", T.StringType())])), "topics")
    bags.drop()
    return out


def _columns(docs: DataFrame, names) -> list:
    return [docs["`" + c.replace("`", "``") + "`"] for c in names]


def _name(topic: int) -> str:
    return "none" if topic < 0 else f"topic-{topic:02}"


def rake(cells: np.ndarray, at: list[np.ndarray], targets: list[np.ndarray], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> np.ndarray:
    """Factors of the cells. ``at``: each dimension's value of each cell; ``targets``: the share of each value."""
    w = cells / cells.sum()
    f = np.ones(len(cells))
    for _ in range(rounds):
        off = 0.0
        for a, t in zip(at, targets):
            have = np.bincount(a, w * f, len(t))
            scale = np.divide(t, have, out=np.ones(len(t)), where=have > 0)
            off = max(off, np.abs(have - t).max())
            f *= scale[a]
        if off < tolerance:
            break
    return f


def scale_of(cells: np.ndarray, f: np.ndarray, clip: float = CLIP) -> float:
    """The factor that stands for probability 1: cells of a higher one hold less than ``clip`` of the tokens."""
    order = np.argsort(-f, kind="stable")
    over = np.cumsum(cells[order])
    return float(f[order][np.searchsorted(over, clip * cells.sum())]) if len(f) and cells.sum() else 1.0


def _targets(shares: dict, given: dict | None, temperature: float) -> dict:
    """Shares to meet, over the values that have tokens: the given weights, or the observed shares to a power, made to sum to 1."""
    t = {k: (given.get(k, 0.0) if given is not None else s**temperature) for k, s in shares.items()}
    total = sum(t.values())
    return {k: v / total for k, v in t.items()} if total else {k: s for k, s in shares.items()}


def _factors(cells: DataFrame, dims: tuple, targets: dict | None, temperature: float, rounds: int) -> DataFrame:
    """cells (dims, tokens) with columns ``p``, the probability, and ``t0``, ``t1``, ...: the targets of the cell's values."""
    spark = cells.sparkSession
    cells = table(cells, "cells")
    targets = targets or {}
    if cells.limit(MAX_CELLS + 1).count() <= MAX_CELLS:
        found = sorted((r for r in cells.collect() if r.tokens > 0), key=lambda r: [(r[d] is not None, r[d]) for d in dims])
        at, want = [], []
        total = sum(r.tokens for r in found)
        for d in dims:
            tokens: dict = {}
            for r in found:
                tokens[r[d]] = tokens.get(r[d], 0) + r.tokens
            values = sorted(tokens, key=lambda v: (v is not None, v))
            t = _targets({v: tokens[v] / total for v in values}, targets.get(d), temperature)
            place = {v: i for i, v in enumerate(values)}
            at.append(np.array([place[r[d]] for r in found], int))
            want.append(np.array([t[v] for v in values]))
        n = np.array([r.tokens for r in found], float)
        f = rake(n, at, want, rounds=rounds) if found else np.zeros(0)
        p = np.minimum(f / scale_of(n, f), 1.0)
        aims = [f"t{i}" for i in range(len(dims))]
        rows = [(*[r[d] for d in dims], float(x), *[float(want[i][at[i][j]]) for i in range(len(dims))]) for j, (r, x) in enumerate(zip(found, p))]
        out = spark.createDataFrame(rows, ", ".join(f"`{d}` {cells.schema[d].dataType.simpleString()}" for d in dims) + ", p double, " + ", ".join(f"{t} double" for t in aims))
        return cells.join(F.broadcast(out), [cells[d].eqNullSafe(out[d]) for d in dims], "left").select(*[cells[d] for d in dims], "tokens", F.coalesce("p", F.lit(1.0)).alias("p"), *[F.coalesce(t, F.lit(0.0)).alias(t) for t in aims])
    total = cells.agg(F.sum("tokens")).first()[0]
    w = cells.withColumns({"factor": F.lit(1.0)} | {f"t{i}": F.lit(0.0) for i in range(len(dims))})
    for _ in range(rounds):
        off = 0.0
        for i, d in enumerate(dims):
            have = w.groupBy(d).agg(F.sum(F.col("tokens") * F.col("factor") / total).alias("_have"), (F.sum("tokens") / total).alias("_share"))
            if d in targets:
                given = spark.createDataFrame(list(targets[d].items()), f"`{d}` {cells.schema[d].dataType.simpleString()}, _w double")
                have = have.join(given, have[d].eqNullSafe(given[d]), "left").select(have[d], "_have", F.coalesce("_w", F.lit(0.0)).alias("_w"))
            else:
                have = have.select(d, "_have", F.pow("_share", F.lit(temperature)).alias("_w"))
            have = table(have, "marginal")
            sum_w = have.where("_have > 0").agg(F.sum("_w")).first()[0] or 1.0
            have = have.select(F.col(d).alias("_v"), F.when(F.col("_have") > 0, F.col("_w") / sum_w / F.col("_have")).otherwise(1.0).alias("_scale"), F.when(F.col("_have") > 0, F.col("_w") / sum_w).otherwise(0.0).alias("_t"), F.abs(F.col("_have") - F.col("_w") / sum_w).alias("_off"))
            off = max(off, have.agg(F.max("_off")).first()[0] or 0.0)
            w = w.join(have, w[d].eqNullSafe(F.col("_v"))).select(*dims, "tokens", (F.col("factor") * F.col("_scale")).alias("factor"), *[F.col("_t").alias(f"t{i}") if j == i else F.col(f"t{j}") for j in range(len(dims))])
        w = table(w, "raked")
        if off < TOLERANCE:
            break
    by_factor = w.where("tokens > 0").groupBy(F.round(F.log("factor"), 6).alias("f")).agg(F.sum("tokens").alias("n"), F.max("factor").alias("top"))
    #: Steps of one millionth: a bounded number of rows, whatever the cells.
    over = by_factor.withColumn("over", F.sum("n").over(Window.orderBy(F.col("f").desc()))).where(F.col("over") >= CLIP * (total or 0)).agg(F.max("top")).first()[0] or 1.0
    return w.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.col("factor") / over, F.lit(1.0))).otherwise(1.0)).drop("factor")


def _read(docs: DataFrame, columns: list, text_col: str, lang_col: str | None, model: Topics | None) -> DataFrame:
    """(row, tokens, topic) of docs, from their texts. ``row`` holds ``columns``; without a model the topic is empty."""
    row = F.struct(*_columns(docs, columns)).alias("row")
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    src = docs.select(row, lang.alias("lang"), *([] if text_col in columns else [F.col(text_col).cast("string").alias("text")]))
    schema = docs.select(row, F.lit(0).cast("long").alias("tokens"), F.lit("").alias("topic")).schema
    at = columns.index(text_col) if text_col in columns else None
    known = docs.sparkSession.sparkContext.broadcast(model)

    @_text.tidy
    def run(batches):
        for batch in batches:
            row, langs = batch.column(0), batch.column(1)
            texts = batch.column(2) if at is None else row.field(at).cast(pa.string())
            for s in _text.slices(pa.record_batch({"row": row, "text": texts, "lang": langs})):
                if known.value is not None:
                    tokens, kind = known.value.of(s.column("text"), s.column("lang").to_pylist())
                    topic = [_name(k) for k in kind.tolist()]
                else:
                    tokens, topic = np.diff(_text.word_starts(*_text.buffers(s.column("text")))[1]), [""] * s.num_rows
                yield pa.RecordBatch.from_arrays([s.column("row"), pa.array(tokens, pa.int64()), pa.array(topic, pa.string())], schema.names)

    return src.mapInArrow(run, schema)


def _weigh(
    docs: DataFrame, dims: tuple, targets: dict | None, temperature: float, rounds: int, id_col: str, text_col: str, lang_col: str, columns: list
) -> tuple[DataFrame, DataFrame, tuple]:
    """(row, tokens, topic, the dimensions' values, i), the cells with their probabilities, and the values' names. ``row`` holds ``columns`` of the caller's, at least."""
    session(docs)
    made = "topic" in dims and "topic" not in docs.columns
    lang = lang_col if lang_col in docs.columns else None
    names = tuple(f"d{i}" for i in range(len(dims)))
    columns = [c for c in docs.columns if c in {*columns, id_col, *dims}]
    whole = text_col in columns
    value = lambda d: F.col("topic") if d == "topic" and made else F.col("row").getField(d).cast("string")
    shown = lambda rows: rows.select("row", "tokens", *[value(d).alias(n) for d, n in zip(dims, names)], value("topic").alias("topic") if "topic" in dims else F.lit(None).cast("string").alias("topic"))
    model, found = None, None
    if made:
        model, bags = _learn(docs, id_col, text_col, lang, [c for c in columns if c in dims] if whole else columns)
        found = shown(_found(model, bags))
    rows = found if made and not whole else shown(_read(docs, columns, text_col, lang, model))
    tokens = (found if made else rows).groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    cells = table(_factors(tokens, names, {n: targets[d] for d, n in zip(dims, names) if d in (targets or {})}, temperature, rounds), "weights")
    if made and whole:
        drop(found)
    return rows, cells, names


def weigh(
    docs: DataFrame, dims: tuple = DIMS, targets: dict | None = None, temperature: float = TEMPERATURE, keep: float = 1.0, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", packed: bool = False, columns: list | None = None
) -> DataFrame:
    """docs with _tokens, _topic, _p (probability) and _kept; columns of these names are replaced. ``packed``: the caller's columns stay in one, ``row``.
    ``columns``: of the caller's, those that are returned; all, if not given.

    A ``topic`` is made from the text if docs have none (a missing ``lang`` or ``source`` is an error).
    """
    columns = docs.columns if columns is None else columns
    rows, cells, names = _weigh(docs, dims, targets, temperature, rounds, id_col, text_col, lang_col, columns)
    f = cells.select(*[F.col(n).alias(f"{n}_") for n in names], (F.col("p") * keep).alias("_p"))
    small = f.limit(MAX_CELLS + 1).count() <= MAX_CELLS
    met = rows.join(F.broadcast(f) if small else f, [rows[n].eqNullSafe(f[f"{n}_"]) for n in names])
    u = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("row").getField(id_col).cast("string"), F.lit("null")), F.lit("mix")), 11) / F.lit(float(2**53))
    new = [F.col("tokens").alias("_tokens"), F.col("topic").alias("_topic"), F.col("_p"), (u < F.col("_p")).alias("_kept")]
    if packed:
        return met.select("row", *new)
    held = [c for c in docs.drop("_tokens", "_topic", "_p", "_kept").columns if c in columns]
    return met.select(*[F.col("row").getField(c).alias(c) for c in held], *new)


def report(
    docs: DataFrame, dims: tuple = DIMS, targets: dict | None = None, temperature: float = TEMPERATURE, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(dimension, value, share, target, expected): each value's share of the tokens, its target, and the share it is expected to have in the sample."""
    _, cells, names = _weigh(docs, dims, targets, temperature, rounds, id_col, text_col, lang_col, docs.columns)
    total = cells.agg(F.sum("tokens").alias("n"), F.sum(F.col("tokens") * F.col("p")).alias("e")).first()
    n, e = float(total.n or 1), float(total.e or 1)
    each = [
        cells.groupBy(name).agg((F.sum("tokens") / n).alias("share"), F.max(f"t{i}").alias("target"), (F.sum(F.col("tokens") * F.col("p")) / e).alias("expected")).select(F.lit(d).alias("dimension"), F.col(name).alias("value"), "share", "target", "expected")
        for i, (d, name) in enumerate(zip(dims, names))
    ]
    return functools.reduce(DataFrame.union, each)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, all columns as they are."""
    kept = weigh(docs, packed=True, **options).where("_kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, topic, probability, kept."""
    w = weigh(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang"), columns=["doc_id"])
    return w.select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_topic").alias("topic"), F.col("_p").alias("probability"), F.col("_kept").alias("kept"))
