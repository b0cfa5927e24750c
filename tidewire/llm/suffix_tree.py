"""LM scoring: a probabilistic suffix tree over words.

Tokens are words (runs other than [\\x20\\x09-\\x0D], A-Z lower-cased) and one end for each text. A state is a context of 0 to DEPTH words. A
context s that was seen LEAST times or more is retained if its next words diverge enough from what its suffix (the context without its first word)
predicts: the sum of count * ln(ratio) over its next words is GAIN or more, and GAIN_EACH for each time that it was seen. The parent of a retained
context is its longest retained proper suffix, or the root. In the longest retained suffix s of what was read, seen c(s) times before t(s) different words,

    P(w | s) = (c(s, w) + KAPPA * t(s) * P(w | parent)) / (c(s) + KAPPA * t(s)),    P(w | root) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),

which sums to one over the vocabulary and one unseen word. So score = base score + what the contexts add.

Every context and next word of the training part is counted, however rare and however large the corpus: the tree grows with the input, and nothing of it is
sent to all machines or to the driver. Texts are cut into slices, kept as a table of word numbers. A slice asks for the sums of its distinct keys (grams
of 1 to DEPTH + 1 words, then contexts) in ranges of their hashes; a range is one task, which adds up what all slices ask and answers each
in its own order. Keys are added up within a slice first, so a gram that is everywhere is one key of each slice, and hashes fall evenly on
ranges; there are as many ranges as the tokens need. Sums are of integers, so they do not hang on the order of rows. Words are told apart by
64-bit hashes, longer grams by KEY bits of theirs.

Null and empty texts are the end alone. Rows that repeat an id are scored each; a null id counts as the text ``null``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._shared import crc_mod, drop, parts, session, table

DEPTH, LEAST = 2, 2
KAPPA, GAIN, GAIN_EACH = 1.0, 6.0, 0.05
#: Bits of the hash that stand for a gram of two words or more.
KEY = 48
#: Bytes of text in a slice (a longer text is one alone), and tokens of the corpus for each range of keys.
SLICE, RANGE = 8 << 20, 1 << 20
#: Gains and shares of different words are summed in steps of 1 / STEP.
STEP = 1024
#: The end's hash.
END = np.uint64(0x6C62272E07BB0142)


def _pack(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, after their width; only as many bytes as the largest needs."""
    x = np.ascontiguousarray(x)
    width = x.dtype.itemsize
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(b: bytes, kind) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    planes = np.frombuffer(pa.decompress(b[9:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


class Slice:
    """Tokens of some texts: ``h`` each word's hash, ``tok`` the tokens' words, ``off`` where each text's begin (and the end), ``train`` which texts are learned from."""

    def __init__(self, h: np.ndarray, tok: np.ndarray, off: np.ndarray, train: np.ndarray, depth: int):
        n = len(tok)
        self.off, self.size = off, np.diff(off)
        self.at = np.arange(n) - np.repeat(off[:-1], self.size)  # place in the text
        self.learn = np.repeat(train, self.size)
        self.grams = [h[tok]]  # of 1, 2, ... words that end at the token; of no meaning where the text has not so many before
        for _ in range(depth):
            g = self.grams[0].copy()
            g[1:] += self.grams[-1][:-1] * np.uint64(0x9FB21C651E98DF25)
            self.grams.append(_text.mix(g))

    def keys(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens that end a gram of k words, their grams' distinct keys in order, and each one's place among these."""
        where = np.flatnonzero(self.at >= k - 1)
        g = self.grams[k - 1][where]
        u, which = np.unique(g if k == 1 else g >> np.uint64(64 - KEY), return_inverse=True)
        return where, u, which

    def contexts(self, k: int, counts: list[np.ndarray], total: int, least: int):
        """Tokens whose context of k words may be a state, that context's keys as above, and the counts c(s), c(s, w), c(suffix), c(suffix, w)."""
        where = np.flatnonzero(self.at >= k)
        c_s, c_sw = counts[k - 1][where - 1], counts[k][where]
        c_p = counts[k - 2][where - 1] if k > 1 else np.full(len(where), total)
        c_pw = counts[k - 1][where]
        ok = (c_s >= least) & ((c_s < c_p) | (k == 1))  # seen as often as its suffix, it predicts the same
        most = np.log(c_p[ok] / c_s[ok]) * c_s[ok]  # of its gain, as c(s, w) <= c(suffix, w): contexts that cannot be retained need not be asked for
        ok[ok] = (most >= GAIN - 0.1) & (most >= GAIN_EACH * c_s[ok] - 0.1)
        where = where[ok]
        u, which = np.unique(self.grams[k - 1][where - 1] >> np.uint64(64 - KEY), return_inverse=True)
        return where, u, which, c_s[ok], c_sw[ok], c_p[ok], c_pw[ok]


def _bounds(ranges: int, bits: int) -> np.ndarray:
    """Where each range of keys but the first begins."""
    return np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)


def _asked(name: str, k: int, keys: np.ndarray, values: np.ndarray, ranges: int, bits: int) -> list[dict]:
    """Rows of a slice's request, by range. ``keys`` are in order; ``values`` are one or more for each."""
    cut = np.concatenate([[0], np.searchsorted(keys, _bounds(ranges, bits)), [len(keys)]])
    return [{"slice": name, "g": (k - 1) * ranges + i, "h": _pack(keys[a:b]), "v": _pack(values[a:b].reshape(-1))} for i, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]


ASK = "slice string, g int, h binary, v binary"


def _add(t: pa.Table) -> pa.Table:
    """Sums of one range, for each slice in the order of its keys; ``found``: how many keys have a sum over 0, once."""
    hs = [_unpack(x.as_py(), np.uint64) for x in t["h"]]
    _, which = np.unique(np.concatenate(hs), return_inverse=True)
    values = np.concatenate([_unpack(x.as_py(), np.int64) for x in t["v"]]).reshape(len(which), -1)
    order = np.argsort(which, kind="stable")
    first = np.flatnonzero(np.diff(which[order], prepend=-1))
    sums = np.add.reduceat(values[order], first, axis=0)
    cut = np.cumsum([0, *map(len, hs)])
    found = np.zeros(len(hs), np.int64)
    found[0] = int((sums[:, 0] > 0).sum())
    return pa.table({"slice": t["slice"], "g": t["g"], "sums": pa.array([_pack(sums[which[a:b]].reshape(-1)) for a, b in zip(cut, cut[1:])], pa.binary()), "found": found})


def _answers(asked: DataFrame, name: str) -> DataFrame:
    return table(asked.groupBy("g").applyInArrow(_add, "slice string, g int, sums binary, found bigint"), name)


def _sums(t: pa.Table, k: int, ranges: int) -> np.ndarray:
    """The answers to a slice's keys of kind k, in their order."""
    rows = sorted((g, x) for g, x in zip(t["g"].to_pylist(), t["sums"].to_pylist()) if (k - 1) * ranges <= g < k * ranges)
    return np.concatenate([np.zeros(0, np.int64), *[_unpack(x, np.int64) for _, x in rows]])


def _cut(docs: DataFrame, kind: str) -> DataFrame:
    """A table of slices from (id, text, train)."""

    @_text.tidy
    def run(batches):
        from pyspark import TaskContext

        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def row():
            text = pa.concat_arrays([b.column("text").cast(pa.string()) for b in held])
            train = np.concatenate([b.column("train").to_numpy(zero_copy_only=False) for b in held]).astype(bool)
            w = _text.Words(text, lower=True)
            first, which = w.unique()
            words = w.bytes(first)
            order = sorted(range(len(words)), key=words.__getitem__)
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            off = w.off + np.arange(len(w.off))
            tok = np.full(off[-1], len(words), np.uint32)  # the end
            rest = np.ones(len(tok), bool)
            rest[off[1:] - 1] = False
            tok[rest] = rank[which]
            return pa.record_batch({
                "slice": [f"{part}-{made}"], "ids": pa.array([pa.concat_arrays([b.column("id") for b in held]).to_pylist()], pa.list_(held[0].column("id").type)), "train": pa.array([train.tolist()], pa.list_(pa.bool_())),
                "off": pa.array([_pack(off)], pa.binary()), "words": pa.array([pa.compress(b" ".join(words[i] for i in order), "zstd", asbytes=True)], pa.binary()), "letters": pa.array([sum(map(len, words)) + max(0, len(words) - 1)], pa.int64()),
                "tok": pa.array([_pack(tok)], pa.binary()), "n": pa.array([len(tok)], pa.int64()), "n_train": pa.array([int(np.diff(off)[train].sum())], pa.int64()),
            })

        for b in batches:
            for s in _text.slices(b):
                held.append(s)
                size += len(_text.buffers(s.column("text"))[0])
                if size >= SLICE:
                    yield row()
                    made, held, size = made + 1, [], 0
        if held:
            yield row()

    return table(docs.mapInArrow(run, f"slice string, ids array<{kind}>, train array<boolean>, off binary, words binary, letters bigint, tok binary, n bigint, n_train bigint"), "slices")


def _slice(t, i: int, depth: int) -> Slice:
    get = lambda c: t.column(c)[i].as_py()
    words = pa.decompress(get("words"), get("letters"), "zstd", asbytes=True)
    h = np.append(_text.Words(pa.array([words], pa.binary())).h, END)
    return Slice(h, _unpack(get("tok"), np.uint32), _unpack(get("off"), np.int64), np.array(get("train"), bool), depth)


def _counts(s: Slice, answers: pa.Table, ranges: int, depth: int) -> list[np.ndarray]:
    """For grams of 1 to depth + 1 words, the count of the gram that ends at each token (0 where there is none)."""
    out = []
    for k in range(1, depth + 2):
        where, _, which = s.keys(k)
        c = np.zeros(len(s.at), np.int64)
        c[where] = _sums(answers, k, ranges)[which]
        out.append(c)
    return out


def lm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs. Ids with crc32 modulo 5 equal to 1 are held out."""
    spark = session(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (crc_mod(id_col, 5) != 1).alias("train"))
    slices = _cut(src, kind)
    size = slices.agg(F.sum("n").alias("n"), F.sum("n_train").alias("train")).first()
    total, ranges = int(size.train or 0), max(parts(spark), -(-int(size.n or 0) // RANGE))

    @_text.tidy
    def ask_counts(batches):
        for b in batches:
            for i in range(b.num_rows):
                s, name = _slice(b, i, depth), b.column("slice")[i].as_py()
                for k in range(1, depth + 2):
                    where, u, which = s.keys(k)
                    n = np.bincount(which[s.learn[where]], minlength=len(u)).astype(np.int64)
                    yield from _batches(_asked(name, k, u, n, ranges, 64 if k == 1 else KEY))

    counts = _answers(slices.mapInArrow(ask_counts, ASK), "counts")
    vocabulary = int(counts.where(F.col("g") < ranges).agg(F.sum("found")).first()[0] or 0)
    norm = total + 0.5 * (vocabulary + 1)

    def ask_gains(t, answers):
        out = []
        for i in range(t.num_rows):
            s, name = _slice(t, i, depth), t.column("slice")[i].as_py()
            c = _counts(s, answers, ranges, depth)
            for k in range(1, depth + 1):
                where, u, which, c_s, c_sw, c_p, c_pw = s.contexts(k, c, total, least)
                learn = s.learn[where]
                x = np.zeros(len(where))
                x[learn] = np.log(c_sw[learn] / c_s[learn]) - np.log(c_pw[learn] / c_p[learn])
                each = np.zeros(len(where))
                each[learn] = 1 / c_sw[learn]  # sums to 1 for each different word
                sums = np.stack([np.bincount(which, x, len(u)), np.bincount(which, each, len(u))], 1)
                out += _asked(name, k, u, np.rint(sums * STEP).astype(np.int64), ranges, KEY)
        return pa.Table.from_pylist(out, ASKED)

    gains = _answers(slices.groupBy("slice").cogroup(counts.groupBy("slice")).applyInArrow(ask_gains, ASK), "gains")

    def score(t, answers):
        out = []
        for i in range(t.num_rows):
            s = _slice(t, i, depth)
            c = _counts(s, answers.filter(pa.array(~np.array(answers["gain"].to_pylist(), bool))), ranges, depth)
            found = answers.filter(answers["gain"])
            root = (c[0] + 0.5) / norm
            p = root.copy()
            for k in range(1, depth + 1):
                where, u, which, c_s, c_sw, _, _ = s.contexts(k, c, total, least)
                gain, types = (_sums(found, k, ranges).reshape(-1, 2)[which] / STEP).T
                state = (gain >= GAIN) & (gain >= GAIN_EACH * c_s)
                at, rest = where[state], KAPPA * np.maximum(types[state], 1)
                p[at] = (c_sw[state] + rest * p[at]) / (c_s[state] + rest)
            cut = s.off[:-1]
            add = lambda x: np.add.reduceat(x, cut)  # noqa: E731  every text has a token, its end
            out.append(pa.table({
                "id": t.column("ids").combine_chunks().flatten() if t.num_rows == 1 else pa.array(t.column("ids")[i].as_py(), t.schema.field("ids").type.value_type), "held_out": pa.array([not x for x in t.column("train")[i].as_py()]),
                "n_tokens": pa.array(s.size.astype(np.int64)), "n_known": pa.array(add((c[0] > 0).astype(np.int64))), "base_score": pa.array(add(np.log10(root))), "score": pa.array(add(np.log10(p))),
            }))
        return pa.concat_tables(out)

    every = counts.withColumn("gain", F.lit(False)).union(gains.withColumn("gain", F.lit(True)))
    scored = table(slices.groupBy("slice").cogroup(every.groupBy("slice")).applyInArrow(score, f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"), "scored")
    drop(slices, counts, gains)
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


ASKED = pa.schema([("slice", pa.string()), ("g", pa.int32()), ("h", pa.binary()), ("v", pa.binary())])


def _batches(rows: list[dict]):
    if rows:
        yield pa.RecordBatch.from_pylist(rows, ASKED)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
