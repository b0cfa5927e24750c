"""Parts without Spark: hashing, codes, distances, samples, graphs, models."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import _text, components, decontamination, hnsw, minhash, mixing, quality, suffix_tree, token_ids, toxicity

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\rabAB,.é漢'0\x1c ", max_size=40)), min_size=1, max_size=8)


@settings(deadline=None, max_examples=60)
@given(TEXTS)
def test_words_are_those_of_a_pattern(texts):
    w = _text.Words(pa.array(texts, pa.string()))
    found = [bytes(w.buf[a:b]) for a, b in zip(w.start, w.end)]
    assert found == [x for t in texts for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
    assert np.diff(w.off).tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for t in texts]
    by: dict = {}
    for x, h in zip(found, w.h.tolist()):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def thue_morse(letters=2048):
    """Two words that a polynomial modulo 2^64 can't tell apart."""
    a, b = "a", "b"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


@settings(deadline=None, max_examples=40)
@given(st.lists(st.sampled_from(["a", "b" * 8, "c" * 9, "d" * 200, "d" * 199 + "e", "f" * 300, "f" * 299 + "g", *thue_morse()]), min_size=1, max_size=30), st.booleans())
def test_different_words_are_told_apart(words, poor):
    w = _text.Words(pa.array([" ".join(words)]))
    if poor:  # right whatever the hashes
        w.h = w.h & np.uint64(1)
        w.h[np.array([len(x) for x in words]) <= 8] = np.array([hash(x) & 0xFFFF for x in words if len(x) <= 8], np.uint64) + np.uint64(9)
    first, which = w.unique()
    assert [w.bytes(first)[k].decode() for k in which] == words and len(first) == len(set(words))


def test_encoder_tells_words_of_equal_polynomials_apart(encoder):
    a, b = thue_morse()
    ids, off = encoder.encode(pa.array([a, b, f"{b} {a}"]))
    for k, t in enumerate([a, b, f"{b} {a}"]):
        assert ids[off[k] : off[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


@settings(deadline=None, max_examples=40)
@given(TEXTS, st.integers(1, 4), st.integers(0, 1))
def test_grams(texts, n, skip):
    w = _text.Words(pa.array(texts, pa.string()))
    _, doc = w.grams(n, skip)
    sizes = [len((t or "").encode().split()) for t in texts]
    assert np.bincount(doc, minlength=len(texts)).tolist() == [max(0, k - n - skip + 1) for k in sizes]
    _, doc = w.shingles(n)
    assert np.bincount(doc, minlength=len(texts)).tolist() == [min(k, max(1, k - n + 1)) for k in sizes]


def test_bucket_counts_find_all_heavy():
    h = _text.mix(np.repeat(np.arange(500, dtype=np.uint64), np.arange(500)))
    c = _text.BucketCounts(1, 1 << 16)
    c.add(0, h[:100])
    c.add(0, h[100:])
    n = np.zeros(1 << 16, np.int64)
    for b in c.rows():
        n[b.column(0)[0].as_py() * _text.CHUNK :][: _text.CHUNK] += _text.unpack(b.column(1)[0].as_py())
    assert n.sum() == len(h) and all(n[int(x % (1 << 16))] >= k for k, x in enumerate(_text.mix(np.arange(500, dtype=np.uint64))))


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_code_round_trip(values):
    control, data = token_ids.pack(np.array(values, np.uint32))
    assert token_ids.unpack(control, data, len(values)).tolist() == values


def test_code_is_byte_aligned():
    control, data = token_ids.pack(np.array([5, 300, 70000, 2**25, 7], np.uint32))
    assert control == bytes([0b11100100, 0]) and data == bytes([5, 44, 1, 112, 17, 1, 0, 0, 0, 2, 7])


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return token_ids.Encoder(public_tokenizers.path("word_bpe_49k.json"))


@settings(deadline=None, max_examples=80)
@given(st.lists(st.text(alphabet="abcXYZéÉßİς'’stvr,.!?;:|#$%&*-_/ \t\n\r\x0b\x1c\x85 ̱́漢1290", max_size=30), min_size=1, max_size=5))
def test_encoder_is_the_library(encoder, texts):
    ids, off = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[off[k] : off[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_with_added_tokens_nulls_and_a_full_cache(encoder, monkeypatch):
    monkeypatch.setattr(token_ids, "CACHE", 8)
    for texts in (["a <|endoftext|> b", None, ""], ["one two three four five"], ["six seven eight nine ten one"], ["it's the one's"] * 3):
        ids, off = encoder.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def edit_distance(item, text):
    """Least distance of the item to any part of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(deadline=None, max_examples=100)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=25))
def test_myers(item, text):
    assert decontamination.myers(item, text, 100) == edit_distance(item, text)


@settings(deadline=None, max_examples=60)
@given(st.data())
def test_pieces_find_every_match(data):
    r = random.Random(data.draw(st.integers(0, 10**6)))
    item = "".join(r.choice("abcd ") for _ in range(40)).strip() + "z" * 30
    text = list(item)
    for _ in range(r.randrange(10)):
        at = r.randrange(len(text))
        text[at : at + r.randrange(2)] = r.choice(["", "x", "yy"])
    text = "lead " + "".join(text) + " tail"
    m = decontamination.Matcher([(7, item)], 0.1)
    d = edit_distance(item, text)
    assert m.find(text) == ([(0, d)] if d <= int(0.1 * len(item)) else [])


def test_weighted_samples_estimate_similarity():
    r = np.random.default_rng(0)
    x = np.unique(_text.mix(np.arange(400, dtype=np.uint64)))
    lnw = np.log(r.choice([0.5, 1.0, 2.0], len(x))).astype(np.float32)
    a, b = np.arange(len(x)) < 320, np.arange(len(x)) >= 40
    true = np.exp(lnw[a & b]).sum() / np.exp(lnw).sum()
    sa, sb = (minhash.samples(x[m], lnw[m], np.array([0])) for m in (a, b))
    assert abs((sa == sb).mean() - true) < 0.2
    every = [[minhash.samples(_text.mix(x[m] + np.uint64(s)), lnw[m], np.array([0])) for m in (a, b)] for s in range(40)]
    assert abs(np.mean([(p == q).mean() for p, q in every]) - true) < 0.02


def test_similarity_is_weighted_jaccard():
    w = minhash.Weights(np.zeros(0, np.uint64), np.zeros(0))
    a, b = "a b c d e f g h", "a b c d e f g z"
    got = minhash.similarity(pa.array([a, "x", "", "one two"]), pa.array([b, "x", "", "one two"]), w)
    assert got.tolist() == pytest.approx([3 / 5, 1.0, 0.0, 1.0])


def test_a_pair_of_few_equal_samples_is_compared():
    h = np.arange(1, 101, dtype=np.uint32)
    pack = lambda x: x.tobytes() + pa.compress(np.ones(len(x), np.float32).tobytes(), "zstd", asbytes=True) + np.uint32(len(x)).tobytes()
    few = [bytes(256), b"".join(np.uint32(i < 24).tobytes() for i in range(64))]  # 40 of 64 samples agree
    rows = {"rep": [1, 2], "w": [90.0, 90.0], "component": [1, 2], "band": [0, 0], "side": [0, 0], "bands": [[7] * minhash.BANDS] * 2, "samples": few, "pack": [pack(h[:90]), pack(h[8:98])]}
    assert minhash._linked(0.8)(pa.table(rows)).to_pylist() == [{"a": 1, "b": 2}]


def test_rake_meets_marginals():
    cells = np.array([100.0, 20, 5, 300, 40, 7, 9, 1])
    at = [np.array([0, 0, 0, 0, 1, 1, 1, 1]), np.array([0, 1] * 4), np.array([0, 0, 1, 1] * 2)]
    want = [np.array([0.5, 0.5]), np.array([0.3, 0.7]), np.array([0.6, 0.4])]
    w = cells / cells.sum() * mixing.rake(cells, at, want)
    for a, t in zip(at, want):
        assert np.bincount(a, w) == pytest.approx(t, abs=1e-6)


def test_graph_finds_all_near():
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16))
    x = np.repeat(centres, 25, axis=0) + 0.1 * r.normal(size=(1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(1000) * 3
    links, every, root = hnsw.search_shard(hnsw.Graph(x), x, ids, np.ones(1000, int), x, ids)
    true = x @ x.T >= hnsw.THRESHOLD
    assert (links == true.sum(1) - 1).mean() > 0.99 and set(root) <= set(every)


def test_unite():
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)]
    got = next(components._unite([pa.record_batch({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]})])).to_pydict()
    assert dict(zip(got["id"], got["component"])) == least_labels(pairs)


def least_labels(pairs):
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in up}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40), st.sampled_from([np.uint8, np.uint32, np.uint64]))
def test_planes_round_trip(values, kind):
    x = np.array(values, np.uint64).astype(kind)
    assert suffix_tree._unpack(suffix_tree._pack(x), kind).tolist() == x.tolist()


@settings(deadline=None, max_examples=40)
@given(st.lists(st.dictionaries(st.integers(0, 2**48 - 1), st.integers(0, 9), max_size=20), min_size=1, max_size=4), st.integers(1, 5))
def test_sums_come_back_in_the_order_of_keys(asked, ranges):
    rows = []
    for n, a in enumerate(asked):
        keys = np.array(sorted(a), np.uint64)
        rows += suffix_tree._asked(f"s{n}", 1, keys, np.array([a[k] for k in sorted(a)], np.int64), ranges, 48)
    answers = [suffix_tree._add(pa.Table.from_pylist([r for r in rows if r["g"] == g], suffix_tree.ASKED)) for g in sorted({r["g"] for r in rows})]
    every = pa.concat_tables(answers) if answers else pa.table({"slice": pa.array([], pa.string()), "g": pa.array([], pa.int32()), "sums": pa.array([], pa.binary()), "found": pa.array([], pa.int64())})
    total = {k: sum(a.get(k, 0) for a in asked) for a in asked for k in a}
    for n, a in enumerate(asked):
        mine = every.filter(pa.array([x == f"s{n}" for x in every["slice"].to_pylist()], pa.bool_()))
        assert suffix_tree._sums(mine, 1, ranges).tolist() == [total[k] for k in sorted(a)]
    assert sum(every["found"].to_pylist()) == sum(v > 0 for v in total.values())


def test_models_learn():
    m = toxicity.Ftrl()
    for _ in range(200):
        m.learn(np.array([3, 5]), 1.0)
        m.learn(np.array([4, 5]), 0.0)
    w = m.weights()
    assert w[3] > 1 and w[4] < -1 and (w != 0).sum() < 6
    x, cut = quality.features(pa.array(["Calm words here. " * 80, "LOUD!! " * 90, None, ""]))
    assert np.diff(cut).tolist() == [4, 2, 1, 1] and np.isfinite(x).all()
    bags = [(x[cut[k] : cut[k + 1]], y) for k, y in ((0, 1.0), (1, 0.0))] * 20
    s = quality.fit_bags(bags, 30).forward(x, cut)[0]
    assert s[0] > 0.9 and s[1] < 0.1


def test_gradients():
    r = np.random.default_rng(0)
    x, cut, y = r.normal(size=(7, quality.SIZE)), np.array([0, 3, 7]), np.array([1.0, 0.0])
    loss = lambda m: -np.mean(y * np.log(s := m.forward(x, cut)[0]) + (1 - y) * np.log(1 - s))
    old = quality.DECAY, quality.RATE
    quality.DECAY, quality.RATE = 0.0, 0.0
    try:
        m = quality.Mil()
        m.step(x, cut, y)
        for k in m.p:
            i = tuple(0 for _ in m.p[k].shape)
            got = m.m[k][i] / 0.1
            e = 1e-5
            m.p[k][i] += e
            up = loss(m)
            m.p[k][i] -= 2 * e
            down = loss(m)
            m.p[k][i] += e
            assert got == pytest.approx((up - down) / (2 * e), abs=1e-6)
    finally:
        quality.DECAY, quality.RATE = old
