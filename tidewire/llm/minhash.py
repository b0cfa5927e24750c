"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text's shingles are its windows of ``SHINGLE`` words (runs other than [\x20\x09-\x0D], ASCII case folded); a text of fewer words is one
window. A shingle weighs (1 + ln tf) * idf, idf = ln(1 + N / df), N and df counted over all documents; df counts as COMMON * N at least, so that
idf is ln(1 + 1 / COMMON) at most. So only the counts of shingles in more than COMMON of the documents need be known everywhere; there are at
most (mean shingles of a document) / COMMON of them, whatever the corpus, and they are sent to the executors. They are found exactly: counts in
hashed buckets first, then true counts of what is in heavy buckets.

Texts that are equal are one class before anything else, null and empty ones too. For the rest, each of SAMPLES samples is the least
``a`` of Ioffe's scheme, whose value stands for its (shingle, t). A band is a fixed choice of ROWS of them. Documents that agree on a band are candidates:

- each member of a band's bucket is compared with the bucket's least id, not with all others;
- where the members then are not all of one component, a task compares members of different components, one against the others at a time:
  sizes first, then shingles; it unites what it links and gives one link for each union, so neither pairs
  nor links of a group are listed. A bucket of up to ``SMALL`` members is one task's work. A larger one is dealt into units of about SMALL, and
  each two units are one task's work, but for units of the same component: no pair of different components is left out.

Candidates are verified on whole texts; those of similarity ``THRESHOLD`` or more are links. A pair at the threshold agrees on a band with
probability 0.9995 or so (the mean of 1 - (1 - p^5)^24 over p = m / 64, m binomial with mean 0.8 * 64). A link can be missed only if all of its pair's ways are; most pairs are also held together by others. Every document belongs to the component of its links; its class is the least id.
Rows that repeat an id are the same document; a null id is a document before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import drop, fresh, session, table
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
SAMPLES, BANDS, ROWS = 64, 24, 5
COMMON = 1e-3
SMALL = 2048
#: Buckets for finding common shingles: at 500 shingles a document, a bucket holds an eighth of the least count that is looked for.
BUCKETS = 1 << 22
#: Bits of the map of the ids whose texts are wanted.
MARKS = 1 << 23
NULL_ID = -(2**63)

_U = (np.arange(65536) + 0.5) / 65536
_E = -np.log(_U).astype(np.float32)


def _gamma() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 65536 steps, by Newton's method on 1 - (1 + x) exp(-x)."""
    x = np.sqrt(2 * _U) + _U
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - _U) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x.astype(np.float32)


_R = _gamma()
_B = _U.astype(np.float32)
_MUL = _text.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BAND = _text.mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(BANDS, ROWS) | np.uint64(1)
#: The samples of each band: every sample is in as many bands as any other, as near as can be.
_PICK = np.concatenate([np.random.default_rng(k).permutation(SAMPLES)[: SAMPLES // ROWS * ROWS].reshape(-1, ROWS) for k in range(-(-BANDS // (SAMPLES // ROWS)))])[:BANDS]


def samples(x: np.ndarray, lnw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Least ln a of each text (rows) for each hash (columns): shingles ``x`` with ln weights, each text's first at ``starts``."""
    out = np.empty((len(starts), len(_MUL)), np.float32)
    odd = np.flatnonzero(lnw)
    for j, m in enumerate(_MUL):
        h = x * m
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        u = h.view(np.uint16).reshape(-1, 4)
        r, b = _R[u[:, 2]], _B[u[:, 3]]
        t = np.ones(len(x), np.float32)
        if len(odd):
            t[odd] += np.floor(lnw[odd] / r[odd] + b[odd])
        a = np.log(_E[u[:, 0]] + _E[u[:, 1]])
        a -= r * (t - b)
        out[:, j] = np.minimum.reduceat(a, starts)
    return out


def bands(mins: np.ndarray) -> np.ndarray:
    v = mins.view(np.uint32).astype(np.uint64)[:, _PICK] * _BAND
    return _text.mix(v.sum(axis=2, dtype=np.uint64)).view(np.int64)


class Weights:
    """ln of common shingles' idf over the largest idf, by search among sorted hashes; all others have 0."""

    def __init__(self, hashes: np.ndarray, lnidf: np.ndarray):
        order = np.argsort(hashes)
        self.h, self.w = hashes[order], lnidf[order].astype(np.float32)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), np.float32)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.w[at], np.float32(0))


def shingles(col: pa.Array, weights: Weights, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order, ln weights, and where each text's begin (and the end)."""
    h, doc = _text.Words(col, lower=True).shingles(n)
    off = np.searchsorted(doc, np.arange(len(col) + 1))
    for a, b in zip(off, off[1:]):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    lnw = weights.of(h)
    many = np.flatnonzero(tf > 1)
    lnw[many] += np.log1p(np.log(tf[many])).astype(np.float32)
    return h, lnw, np.searchsorted(doc, np.arange(len(col) + 1))


def common_shingles(docs: DataFrame, total: int, n: int = SHINGLE) -> Weights:
    """Shingles of more than COMMON of all ``total`` documents. ``docs``: (id, text)."""
    least = int(COMMON * total) + 1

    @_text.tidy
    def count(batches):
        counts = _text.BucketCounts(1, BUCKETS)
        for b in batches:
            for s in _text.slices(b):
                counts.add(0, _text.Words(s.column("text"), lower=True).shingles(n)[0])
        yield from counts.rows()

    heavy = _text.heavy_buckets(docs.select("text").mapInArrow(count, "chunk int, data binary"), 1, BUCKETS, least)[0]
    if not heavy.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0))
    sent = session(docs).sparkContext.broadcast(heavy)

    @_text.tidy
    def exact(batches):
        for b in batches:
            for s in _text.slices(b):
                h, doc = _text.Words(s.column("text"), lower=True).shingles(n)
                hot = _text.in_bitmap(sent.value, h)
                h, _, _ = _text.distinct(h[hot], doc[hot])
                h, df = np.unique(h, return_counts=True)
                yield pa.record_batch({"h": pa.array(h.view(np.int64)), "df": pa.array(df)})

    rows = docs.select("text").mapInArrow(exact, "h bigint, df bigint").groupBy("h").agg(F.sum("df").alias("df")).where(F.col("df") >= least).toArrow()
    h, df = rows["h"].to_numpy().view(np.uint64), rows["df"].to_numpy()
    return Weights(h, np.log(np.log1p(total / df) / np.log1p(1 / COMMON)))


def _sketch(docs: DataFrame, weights, n: int) -> DataFrame:
    @_text.tidy
    def run(batches):
        import xxhash

        for b in batches:
            for s in _text.slices(b):
                h, lnw, off = shingles(s.column("text"), weights.value, n)
                raw, at = _text.buffers(s.column("text"))
                digest = [xxhash.xxh128_digest(raw[i:j]) for i, j in zip(at, at[1:])]
                found = np.flatnonzero(np.diff(off))
                out: list = [None] * s.num_rows
                total = np.zeros(s.num_rows)
                first = 0
                while first < len(found):  # of few shingles at a time, which stay in the cache
                    last = max(first + 1, int(np.searchsorted(off[found], off[found[first]] + 40_000)))
                    lo, hi = off[found[first]], off[found[last - 1] + 1]
                    mins = samples(h[lo:hi], lnw[lo:hi], off[found[first:last]] - lo)
                    mine = bands(mins)
                    total[found[first:last]] = np.add.reduceat(np.exp(lnw[lo:hi], dtype=np.float64), off[found[first:last]] - lo)
                    for i, x in zip(found[first:last], mine):
                        out[i] = x
                    first = last
                yield pa.record_batch({"id": s.column("id"), "digest": pa.array(digest, pa.binary()), "w": pa.array(total), "bands": pa.array(out, pa.list_(pa.int64()))})

    return docs.mapInArrow(run, "id bigint, digest binary, w double, bands array<bigint>")


def similarity(a: pa.Array, b: pa.Array, weights: Weights, n: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts."""
    (ha, la, oa), (hb, lb, ob) = shingles(a, weights, n), shingles(b, weights, n)
    h = np.concatenate([ha, hb])
    w = np.exp(np.concatenate([la, lb]), dtype=np.float64)
    k = np.arange(len(a))
    doc = np.concatenate([np.repeat(k, np.diff(oa)), np.repeat(k, np.diff(ob))])
    order = np.lexsort((h, doc))
    h, w, doc = h[order], w[order], doc[order]
    both = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, int)
    shared = np.bincount(doc[both], np.minimum(w[both], w[both + 1]), len(a))
    union = np.bincount(doc, w, len(a)) - shared
    return np.divide(shared, union, out=np.zeros(len(a)), where=union > 0)


def _verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float, n: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar, as a table."""

    @_text.tidy
    def run(batches):
        for b in batches:
            for s in _text.slices(b, "ta"):
                for x in _text.slices(s, "tb"):
                    ok = similarity(x.column("ta"), x.column("tb"), weights.value, n) >= threshold - 1e-9
                    yield pa.record_batch({"a": x.column("a"), "b": x.column("b")}).filter(pa.array(ok))

    texts = texts.select("id", "text")
    ta, tb = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return table(pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint"), "links")


def _packed(docs: DataFrame, wanted: DataFrame, weights, n: int) -> DataFrame:
    """(id, text, pack) of the wanted ids: ``pack`` is the text's shingles as sorted 32-bit hashes and weights.

    Which texts are wanted is looked up in a bitmap of hashed ids, of fixed size, before any text moves; a join then drops the few it let by.
    """

    @_text.tidy
    def mark(batches):
        c = _text.BucketCounts(1, MARKS)
        for b in batches:
            c.add(0, _text.mix(b.column(0).to_numpy().view(np.uint64).copy()))
        yield from c.rows()

    bitmap = session(docs).sparkContext.broadcast(_text.heavy_buckets(wanted.mapInArrow(mark, "chunk int, data binary"), 1, MARKS, 1)[0])

    @_text.tidy
    def pick(batches):
        for b in batches:
            b = b.filter(pa.array(_text.in_bitmap(bitmap.value, _text.mix(b.column(0).to_numpy().view(np.uint64).copy()))))
            for s in _text.slices(b):
                h, lnw, off = shingles(s.column("text"), weights.value, n)
                h32 = (h >> np.uint64(32)).astype(np.uint32)  # of sorted hashes, so sorted
                pack = [h32[i:j].tobytes() + pa.compress(np.exp(lnw[i:j], dtype=np.float32).tobytes(), "zstd", asbytes=True) + np.uint32(j - i).tobytes() for i, j in zip(off, off[1:])]
                yield pa.record_batch({"id": s.column("id"), "text": s.column("text"), "pack": pa.array(pack, pa.binary())})

    return docs.mapInArrow(pick, "id bigint, text string, pack binary").join(wanted, "id")


def _unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int(np.frombuffer(b[-4:], np.uint32)[0])
    return np.frombuffer(b, np.uint32, k), np.frombuffer(pa.decompress(b[4 * k : -4], 4 * k, "zstd", asbytes=True), np.float32)


def _dealt(rows: DataFrame, small: int) -> DataFrame:
    """Members (g, band, rep, w, n, component) of buckets as (t, side, band, rep, w, component): a group ``t`` is a bucket of up to ``small`` members, or of a larger one two units, side 0 and side 1, or one alone.

    A component of more than ``small`` members has units of its own, by hash of the member; the others share units, by hash of the component.
    Units of one component are not dealt together. So a bucket that is mostly one component makes rows in proportion to its size.
    """
    fits = rows.where(F.col("n") <= small).select(F.col("g").alias("t"), F.lit(0).alias("side"), "band", "rep", "w", "component")
    many = rows.where(F.col("n") > small)
    sizes = table(many.groupBy("g", "component").agg(F.count("*").alias("c")), "sizes")
    rest = table(sizes.groupBy("g").agg(F.sum(F.when(F.col("c") <= small, F.col("c")).otherwise(0)).alias("rest")), "rest")
    big = F.col("c") > small
    of = lambda x, n: F.pmod(F.xxhash64(x), F.greatest(F.ceil(F.col(n) / small), F.lit(1)))
    unit = F.struct(big.alias("big"), F.when(big, F.col("component")).otherwise(0).alias("of"), F.when(big, of("rep", "c")).otherwise(of("component", "rest")).alias("i"))
    many = table(many.join(sizes, ["g", "component"]).join(rest, "g").select("g", unit.alias("u"), "band", "rep", "w", "component"), "units")
    units = table(many.select("g", "u").distinct(), "unit")
    two = units.withColumnRenamed("u", "x").join(units.withColumnRenamed("u", "y"), "g").where("x <= y and not (x.big and y.big and x.of = y.of)")
    two = table(two.select("g", "x", "y", F.xxhash64("g", "x", "y").alias("t")), "pairs")
    of_unit = two.select("g", "t", F.lit(0).alias("side"), F.col("x").alias("u")).union(two.where("x <> y").select("g", "t", F.lit(1), "y"))
    return fits.union(many.join(of_unit, ["g", "u"]).select("t", "side", "band", "rep", "w", "component"))


def _linked(threshold: float):
    """Of one group's members, links (a, b) that unite components; a pair is compared in its first common band only. Where there are two sides, only members of different ones are compared."""

    def run(t):
        t = t.combine_chunks()
        rep, w = t["rep"].to_numpy(), t["w"].to_numpy()
        _, comp = np.unique(t["component"].to_numpy(), return_inverse=True)
        band = t["band"][0].as_py()
        side = t["side"].to_numpy()
        apart = side.any()
        b = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(rep), BANDS)[:, :band]
        packs = [_unpacked(x) for x in t["pack"].to_pylist()]
        ids, at = np.unique(np.concatenate([h for h, _ in packs]), return_inverse=True)
        weight = np.concatenate([x for _, x in packs])
        cut = np.append(0, np.cumsum([len(h) for h, _ in packs]))
        total = np.add.reduceat(weight, cut[:-1], dtype=np.float64)
        mine = np.zeros(len(ids), np.float32)
        out = []
        for i in range(len(rep)):
            other = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            other = other[np.minimum(w[other], w[i]) >= np.maximum(w[other], w[i]) * (threshold - 1e-6)]
            other = other[~(b[other] == b[i]).any(1)]
            if apart:
                other = other[side[other] != side[i]]
            if not len(other):
                continue
            own = slice(cut[i], cut[i + 1])
            mine[at[own]] = weight[own]
            size = cut[other + 1] - cut[other]
            where = np.repeat(cut[other] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            shared = np.add.reduceat(np.minimum(mine[at[where]], weight[where]), np.cumsum(size) - size, dtype=np.float64)
            mine[at[own]] = 0
            for j in other[shared >= (threshold - 1e-6) * (total[i] + total[other] - shared)]:
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, n: int = SHINGLE, small: int = SMALL) -> DataFrame:
    """(doc_id, component_id, kept) for each row of docs: the class's least id, and whether it is the row's own."""
    spark = session(docs)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    weights = spark.sparkContext.broadcast(common_shingles(src, src.count(), n))
    sketch = table(_sketch(src, weights, n), "sketch")
    #: A table, so that the join has an exchange on either side and Spark may split the rows of a text that a third of the corpus is.
    reps = table(sketch.groupBy("digest").agg(F.min("id").alias("rep")), "first")
    members = table(sketch.select("id", "digest").join(reps, "digest").select("id", "rep"), "members")
    reps = table(sketch.join(reps, (sketch.digest == reps.digest) & (sketch.id == reps.rep)).where("bands is not null").select("rep", "w", "bands").dropDuplicates(["rep", "w"]), "reps")
    drop(sketch)

    rows = reps.select("rep", "w", F.posexplode("bands").alias("band", "v")).select("rep", "w", "band", F.xxhash64("band", "v").alias("g"))
    links = labels = texts = None
    size = rows.groupBy("g").agg(F.min(F.struct("rep", "w")).alias("lead"), F.count("*").alias("n")).where("n > 1")
    met = table(rows.join(size, "g"), "buckets")
    if not met.isEmpty():
        texts = table(_packed(src, table(met.select(F.col("rep").alias("id")).distinct(), "wanted"), weights, n), "texts")
        fits = F.least("wa", "w") >= F.greatest("wa", "w") * (threshold - 1e-6)  # no other pair can be similar enough
        star = met.select(F.col("lead.rep").alias("a"), F.col("lead.w").alias("wa"), F.col("rep").alias("b"), "w").where(F.col("a") < F.col("b")).where(fits)
        links = _verified(star.select("a", "b").distinct(), texts, weights, threshold, n)
        labels = components(links)

        rows = met.select("g", "band", "rep", "w", "n").join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = rows.groupBy("g").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("g")
        rows = table(rows.join(mixed, "g"), "mixed")
        drop(met)
        members_ = reps.select("rep", "w", "bands").join(texts.select(F.col("id").alias("rep"), "pack"), "rep")
        new = _verified(_dealt(rows, small).join(members_, ["rep", "w"]).groupBy("t").applyInArrow(_linked(threshold), "a bigint, b bigint").distinct(), texts, weights, threshold, n)
        if not new.isEmpty():
            links = table(links.union(new), "links")
            labels = components(links)
    drop(*[t for t in (reps, texts, links) if t is not None])
    out = members
    if labels is not None:
        out = members.join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        out = members.withColumn("component", F.col("rep"))
    return out.select(F.col("id").alias("doc_id"), F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with the least id of their class, all columns as they are."""
    (name,) = fresh(docs, "_kept_id")
    found = near_dups(docs, id_col, text_col, **options).where("kept").select(F.col("doc_id").alias(name))
    return docs.join(found, F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) == F.col(name), "left_semi")


def op2_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "component_id", "kept")
