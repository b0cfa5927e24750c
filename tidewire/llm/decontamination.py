"""Benchmark decontamination: pigeonhole edit matching, verified with Myers' bit-parallel distance.

Texts and items are normalised: lower case, runs of other than letters and digits one space. An item of m characters occurs in a text if
some part of the text is within k = floor(``budget`` * m) edits of it. Each item is split into k + 1 pieces; one of them must then be in the
text unchanged, and not further than k from its place. One automaton finds all pieces in one pass of each whole text; around the hits, and
nowhere else, the distance is worked out, if the part has enough of the item's GRAM-letter strings: an edit destroys GRAM of them at most.

Items whose normal form is under ``least`` characters occur only where they are whole words of the text, unchanged, as anything would match
otherwise. Items without a letter or digit (null and empty ones too) and null and empty texts match nothing. Items that repeat an id or a text each count. Items are worked on in blocks of at most
``BLOCK_CHARS`` normalised characters, one pass of the corpus to a block, so that what is sent to executors and held by a task is bounded whatever the items.
"""

from __future__ import annotations

import functools
import itertools
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import drop, fresh, same_columns, session, table

BUDGET, LEAST, GRAM = 0.08, 30, 5
#: Normalised characters of items in one automaton.
BLOCK_CHARS = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


#: ASCII bytes: letters in lower case, digits as they are, all else a space; other bytes as they are.
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = [c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(128)]
#: UTF-8 bytes that Latin-1 letters never have: lead bytes but 0xC3; its two signs are looked for apart.
_ODD = np.zeros(256, bool)
_ODD[0xC0:] = True
_ODD[0xC3] = False


def normalise_all(col: pa.Array) -> list[str]:
    """``normalise`` of each text of a slice. Texts of ASCII and Latin-1 letters are worked on as bytes, together."""
    buf, off = _text.buffers(col)
    if not len(buf):
        return [""] * len(col)
    odd = _ODD[buf]
    sign = np.flatnonzero((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
    odd[sign] = True
    odd = np.append(0, np.cumsum(odd))
    t = _TABLE[buf]
    space = t == 32
    keep = np.ones(len(t), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[off[:-1][off[:-1] < len(t)]] = True
    t, at = t[keep].tobytes(), np.append(0, np.cumsum(keep))[off].tolist()
    slow = (odd[off[1:]] > odd[off[:-1]]).tolist()
    return [normalise(col[i].as_py()) if slow[i] else t[a:b].decode().lower().strip() for i, (a, b) in enumerate(zip(at, at[1:]))]


def pieces(item: str, budget: float) -> list[tuple[int, str]]:
    """(place, piece): k + 1 pieces that make up the item."""
    k = int(budget * len(item))
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, k: int) -> int:
    """Least edit distance of the item to any part of the text, or k + 1 if it is over k."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, at, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            at += 1
        elif mh & top:
            at -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if at < best:
            best = at
            if not best:
                return 0
    return min(best, k + 1)


def _grams(t: str) -> set[str]:
    return {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)}


class Matcher:
    def __init__(self, items: list[tuple], budget: float, least: int = 0):
        import ahocorasick

        self.items, self.short = [t for _, t in items], [len(t) < least for _, t in items]
        self.k = [0 if short else int(budget * len(t)) for t, short in zip(self.items, self.short)]
        self.ids = [i for i, _ in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.items):
            for at, p in [(0, t)] if self.short[n] else pieces(t, budget):
                places.setdefault(p, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for p, where in places.items():
            self.automaton.add_word(p, (len(p), where))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item's number, its distance) of every item that occurs in the normalised text."""
        if not len(self.automaton):
            return []
        spans: dict[int, list[tuple[int, int]]] = {}
        words = set()  # short items
        for end, (size, where) in self.automaton.iter(text):
            for n, at in where:
                start = end + 1 - size - at  # where the item would begin
                if self.short[n]:
                    if text[start - 1 : start] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                        words.add(n)
                    continue
                lo, hi = max(0, start - self.k[n]), min(len(text), start + len(self.items[n]) + self.k[n])
                mine = spans.setdefault(n, [])
                if mine and lo <= mine[-1][1] and lo >= mine[-1][0]:
                    mine[-1] = (mine[-1][0], max(hi, mine[-1][1]))
                else:
                    mine.append((lo, hi))
        out = [(n, 0) for n in words]
        for n, mine in spans.items():
            best = self.k[n] + 1
            for lo, hi in mine:
                part = text[lo:hi]
                if self.items[n] in part:
                    best = 0
                    break
                grams = _grams(self.items[n])
                if len(grams & _grams(part)) >= len(grams) - GRAM * self.k[n]:
                    best = min(best, myers(self.items[n], part, self.k[n]))
            if best <= self.k[n]:
                out.append((n, best))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (id, normalised text) of at most BLOCK_CHARS characters, or one item. The driver holds one at a time."""
    block, size = [], 0
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).orderBy("id", "text")
    few = (items.agg(F.sum(F.length(text_col))).first()[0] or 0) <= BLOCK_CHARS
    for r in rows.collect() if few else rows.toLocalIterator():
        t = normalise(r.text)
        if not t:
            continue
        if block and size + len(t) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r.id, t))
        size += len(t)
    if block:
        yield block


def decontaminate(docs: DataFrame, items: DataFrame, budget: float = BUDGET, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item occurs, all columns as they are."""
    (out,) = fresh(docs, "_hits")
    return hits(docs, items, budget, least, text_col, out=out).where(F.size(out) == 0).select(*same_columns(docs))


#: The matcher of the block that this Python worker met last, by the block's name.
_last: dict[str, Matcher] = {}


def _matcher(name: str, block: list[tuple], budget: float, least: int) -> Matcher:
    if name not in _last:
        _last.clear()
        _last[name] = Matcher(block, budget, least)
    return _last[name]


def hits(docs: DataFrame, items: DataFrame, budget: float = BUDGET, least: int = LEAST, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "_hits") -> DataFrame:
    """``docs`` with a column ``out`` (one of that name is replaced), array of (id, d): each item that occurs in the row's text and its least distance, in order of id.

    Items of one block are looked for where the rows are; no row is shuffled. Of more blocks each is a pass of its own, so that a task never holds
    two; a pass writes what it found by the text's SHA-256, and the rows then meet that.
    """
    spark = session(docs)
    kind = f"array<struct<id: {items.schema[item_id].dataType.simpleString()}, d: int>>"
    nothing = F.expr(f"cast(array() as {kind})")

    def found_in(rows: DataFrame, block: list[tuple], keep_all: bool) -> DataFrame:
        """``rows``, the last column of which takes what was found; only those with a hit unless ``keep_all``."""
        sent, name, names = spark.sparkContext.broadcast(block), uuid.uuid4().hex, rows.columns
        at = names.index(text_col)

        @_text.tidy
        def run(batches):
            m = _matcher(name, sent.value, budget, least)
            for batch in batches:
                for b in _text.slices(batch, text_col):
                    found = [[{"id": m.ids[n], "d": d} for n, d in m.find(t)] for t in normalise_all(b.column(at))]
                    b = pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, b.column(len(names) - 1).type)], names)
                    yield b if keep_all else b.filter(pa.array([bool(x) for x in found]))

        return rows.mapInArrow(run, rows.schema)

    blocks = _blocks(items, item_id, item_text)
    first, second = next(blocks, None), next(blocks, None)
    if second is None:
        found = docs.drop(out).withColumn(out, nothing)
        found = found_in(found, first, True) if first else found
    else:
        key, mine = fresh(docs, "_sha", "_found")
        sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
        texts = docs.select(sha.alias(key), F.col(text_col)).withColumn(mine, nothing)
        passes = [table(found_in(texts, block, False).select(key, mine).dropDuplicates([key]), "hits") for block in itertools.chain((first, second), blocks)]
        of_text = table(functools.reduce(DataFrame.union, passes).groupBy(key).agg(F.flatten(F.collect_list(mine)).alias(mine)), "hits")
        drop(*passes)
        found = docs.drop(out).withColumn(key, sha).join(of_text, key, "left").select(*same_columns(docs.drop(out)), F.coalesce(mine, nothing).alias(out))
    best = F.array_sort(out)
    return found.withColumn(out, F.filter(best, lambda x, i: (i == 0) | ~x["id"].eqNullSafe(F.get(best, i - 1)["id"])))


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (in order), distances."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", (F.size("_hits") > 0).alias("contaminated"), F.size("_hits").cast("long").alias("n_items"), F.col("_hits.id").alias("item_ids"), F.col("_hits.d").alias("distances"))
