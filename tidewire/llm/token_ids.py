"""Token-ID / binary output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

File format: a folder with two Parquet tables, whose files hold only binary streams and what finds them.
``ranks``: (rank, id): ids by falling count over the whole corpus, ties by id. ``blocks``: (shard, block, start, n_tokens, doc_ids, lengths,
control, data), shards and blocks in ascending id. A token's rank takes 1 to 4 bytes of ``data``, little end first; its length less one is two
bits of ``control``, four tokens to a byte, the first in the lowest bits. Parquet is the container because Spark commits its files whole,
in any store, however often a task is tried; block streams decode by themselves.

Null and empty texts are the end id alone. Documents of the same id lie together in the order of their ids' bytes; null ids come first.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text
from ._shared import drop, new_path, parts, session, table

#: Tokens in a block, at most one document more.
BLOCK = 1 << 18
#: Words whose ids a Python worker remembers; if there are more, the half that is met most stays.
CACHE = 300_000
#: Bytes of such words, or all are forgotten: some may be very long.
CACHE_BYTES = 16 << 20
END_ID = 1

_workers: dict[str, Encoder] = {}


#: Fixed value: the pattern of the public tokenizer's pieces. None of them holds white space, and none holds a letter next to one of _text.MARKS.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters of ASCII and Latin-1, small ASCII ones only: each has a lower case of one letter, and none is joined to another.
_LATIN = re.compile("[a-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """Latin-1 letters to the byte-level alphabet, in lower case: a printable byte stands for itself, the n-th other one for code point 256 + n."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    letter = {b: chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).lower().encode()) for c in range(0xC0, 0x100)}


_BYTES = _byte_letters()


class Encoder:
    """A tokenizer with a cache of words.

    Where the tokenizer never joins what white space, or a letter meeting a mark, parts (its file says so), words are encoded one by one,
    each new word once: a text's ids are its words' ids in order. Words are told apart by their bytes. A text that holds an added token's string
    is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre = (d.get("pre_tokenizer") or {}).get("pretokenizers") or [d.get("pre_tokenizer") or {}]
        norms = {x["type"] for x in (d.get("normalizer") or {}).get("normalizers") or []}
        first = pre[0]
        self.by_word = (
            first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first["pattern"].get("Regex") == PIECES
            and norms == {"NFC", "Replace", "Lowercase"} and d.get("post_processor") is None and not d["model"].get("dropout")
        )
        self.added = [t["content"].encode() for t in d.get("added_tokens", [])]
        self._forget(np.zeros(0, np.int64))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _workers:
            _workers[path] = cls(path)
        return _workers[path]

    def _forget(self, keep: np.ndarray) -> None:
        """Keep these rows of the cache only."""
        if not len(keep):
            self.words: list[bytes] = []
            self.at, self.size, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.pool = np.zeros(0, self.kind)
        else:
            size = self.size[keep]
            self.pool = self.pool[_ranges(self.at[keep], size)]
            self.at, self.size, self.hits = np.cumsum(size) - size, size, self.hits[keep] // 2
            self.words = [self.words[i] for i in keep.tolist()]
        self.rows = dict(zip(self.words, range(len(keep))))
        self.held = sum(map(len, self.words))

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word. Lower-case words of Latin letters are one piece, which the model alone encodes; others take the whole way."""
        out: list = [None] * len(words)
        rest = []
        model = self.tokenizer.model
        for i, w in enumerate(words):
            if _LATIN.fullmatch(w):
                out[i] = np.array([t.id for t in model.tokenize(w if w.isascii() else w.translate(_BYTES))], self.kind)
            else:
                rest.append(i)
        for i, x in zip(rest, self._ids([words[i] for i in rest])):
            out[i] = x
        return out

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and where each text's begin (and the end)."""
        raw, off = _text.buffers(col)
        b = raw.tobytes()
        if not self.by_word or any(t in b for t in self.added):
            ids = self._ids(["" if t is None else t for t in col.to_pylist()])
            return np.concatenate(ids), np.append(0, np.cumsum([len(x) for x in ids]))
        #: Lower case first merges words, but for letters that a combining mark could join.
        w = _text.Words(col, lower=not (b"\xcc" in b or b"\xcd" in b), part=True)
        first, which = w.unique()
        words = w.bytes(first)
        if len(self.rows) + len(words) > CACHE or self.held > CACHE_BYTES:
            most = np.argsort(-self.hits, kind="stable")[: CACHE // 2]
            self._forget(np.sort(most[self.hits[most] > 0]))
            if self.held > CACHE_BYTES // 2:
                self._forget(np.zeros(0, np.int64))
        row = np.array([self.rows.get(x, -1) for x in words], np.int64)
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids = self._words([x.decode("utf-8", "replace") for x in fresh])
            size = np.array([len(x) for x in ids], np.int64)
            row[new] = len(self.size) + np.arange(len(new))
            self.rows.update(zip(fresh, row[new].tolist()))
            self.words += fresh
            self.held += sum(map(len, fresh))
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(size) - size])
            self.pool = np.concatenate([self.pool, *ids])
            self.size = np.concatenate([self.size, size])
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.hits[row] += np.bincount(which, minlength=len(words)) - 1  # a word met once only is forgotten first
        mine = row[which]
        size = self.size[mine]
        ends = np.append(0, np.cumsum(size))
        return self.pool[_ranges(self.at[mine], size)], ends[w.off]


def _ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (size[0] numbers), at[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    r = ranks.astype(np.uint32)
    more = [np.flatnonzero(r >= 1 << (8 * k)) for k in (1, 2, 3)]
    code = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    for m in more:
        code[m] += 1
    at = np.cumsum(code[: len(r)].astype(np.int64) + 1) - code[: len(r)] - 1
    data = np.zeros(len(r) + sum(map(len, more)), np.uint8)
    data[at] = r & 255
    for k, m in enumerate(more, 1):
        data[at[m] + k] = (r[m] >> np.uint32(8 * k)) & 255
    c = code.reshape(-1, 4)
    return (c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes(), data.tobytes()


#: Lengths of the four tokens of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks, by a table of lengths for each control byte."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    r = raw[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        if len(more):
            r[more] |= raw[at[more] + k] << np.uint32(8 * k)
    return r & MASKS[size]


def _counts(ids: DataFrame, vocab: int, kind: np.dtype) -> np.ndarray:
    """Counts of all ids over the corpus; ``vocab`` numbers come to the driver."""
    size = -(-vocab // _text.CHUNK) * _text.CHUNK

    @_text.tidy
    def count(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            raw, _ = _text.buffers(b.column(0))
            n += np.bincount(raw.view(kind), minlength=size)
        for c in range(0, size, _text.CHUNK):
            yield pa.record_batch({"chunk": pa.array([c // _text.CHUNK], pa.int32()), "data": pa.array([_text.pack(n[c : c + _text.CHUNK])], pa.binary())})

    out = np.zeros(size, np.int64)
    for r in _text.sum_chunks(ids.mapInArrow(count, "chunk int, data binary"), size // _text.CHUNK).collect():
        out[r.chunk * _text.CHUNK : (r.chunk + 1) * _text.CHUNK] = _text.unpack(bytes(r.data))
    return out[:vocab]


def write(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text and write the files; returns their folder. ``tokenizer`` is a file that every machine has."""
    spark = session(docs)
    path = path or new_path(spark, "tokens")
    encoder = Encoder.of(tokenizer)
    vocab, kind = encoder.tokenizer.get_vocab_size(), encoder.kind
    end = np.array([end_id], kind).tobytes()

    @_text.tidy
    def encode(batches):
        e = Encoder.of(tokenizer)
        for batch in batches:
            for s in _text.slices(batch):
                ids, off = e.encode(s.column("text"))
                b, off = ids.tobytes(), (off * kind.itemsize).tolist()
                yield pa.record_batch({"doc_id": s.column("doc_id"), "ids": pa.array([b[i:j] + end for i, j in zip(off, off[1:])], pa.binary())})

    ids = table(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, "doc_id bigint, ids binary"), "ids")
    n = _counts(ids.select("ids"), vocab, kind)
    by_rank = np.lexsort((np.arange(vocab), -n)).astype(np.uint32)
    rank = np.empty(vocab, np.uint32)
    rank[by_rank] = np.arange(vocab, dtype=np.uint32)
    sent = spark.sparkContext.broadcast(rank)

    @_text.tidy
    def blocks(batches):
        from pyspark import TaskContext

        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held: list = []
        size = 0

        def row():
            length = [len(x) // kind.itemsize for _, x in held]
            control, data = pack(sent.value[np.frombuffer(b"".join(x for _, x in held), kind)])
            return pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "start": pa.array([start], pa.int64()), "n_tokens": pa.array([size], pa.int64()),
                "doc_ids": pa.array([[d for d, _ in held]], pa.list_(pa.int64())), "lengths": pa.array([length], pa.list_(pa.int64())),
                "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary()),
            })

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                held.append((d, x.as_py()))
                size += len(held[-1][1]) // kind.itemsize
                if size >= BLOCK:
                    yield row()
                    held, block, start, size = [], block + 1, start + size, 0
        if held:
            yield row()

    spark.createDataFrame(pa.table({"rank": np.arange(vocab, dtype=np.int32), "id": by_rank.astype(np.int32)})).coalesce(1).write.parquet(f"{path}/ranks")
    (
        ids.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
        .mapInArrow(blocks, "shard int, block int, start bigint, n_tokens bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary")
        .write.parquet(f"{path}/blocks")
    )
    drop(ids)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit integers)."""
    ranks = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")  # as many rows as the vocabulary
    sent = spark.sparkContext.broadcast(ranks["id"].to_numpy(np.uint32))
    blocks = spark.read.parquet(f"{path}/blocks")

    @_text.tidy
    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = sent.value[unpack(r["control"], r["data"], r["n_tokens"])].astype("<u4")
                cut = np.cumsum([0, *r["lengths"]])
                yield pa.record_batch({
                    "shard": pa.array([r["shard"]] * len(r["doc_ids"]), pa.int32()), "doc_id": pa.array(r["doc_ids"], pa.int64()), "at": pa.array(cut[:-1] + r["start"]),
                    "n_tokens": pa.array(np.diff(cut)), "ids": pa.array([ids[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                })

    #: One row for each shard, of which there are as many as partitions were written.
    base = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    out = blocks.mapInArrow(decode, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids binary")
    return out.join(F.broadcast(base), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def token_ids(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write, read back and digest. The default tokenizer is the public one named in the contract."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return digest(read(session(docs), write(docs, tokenizer, id_col=id_col, text_col=text_col)))


def op9_token_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
