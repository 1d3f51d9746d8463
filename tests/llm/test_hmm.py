import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import hmm


def tiny(seed=0, states=3, classes=5):
    rng = np.random.default_rng(seed)
    start, move, emit = rng.random(states), rng.random((states, states)), rng.random((hmm.CLASSES, states))
    emit[classes:] = 1e-9
    return hmm.Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(seq, m):
    for path in itertools.product(range(len(m.start)), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, c in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[c, b]
        yield path, p


def test_forward_and_expected_counts_equal_sums_over_paths():
    m = tiny()
    seqs = [[0, 1, 2, 4], [3], [1, 1, 0], [2, 2, 4, 0, 1]]
    flat, size = np.concatenate([np.array(s, np.uint16) for s in seqs]), np.array([len(s) for s in seqs])
    want = [math.log(sum(p for _, p in paths(s, m))) for s in seqs]
    assert np.allclose(hmm.log_likelihood(flat, size, m), want)
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES, 3))
    for s in seqs:
        total = sum(p for _, p in paths(s, m))
        for path, p in paths(s, m):
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for c, z in zip(s, path):
                emit[c, z] += p / total
    got = hmm.expected(flat, size, m)
    assert np.allclose(got[0], start, atol=1e-5) and np.allclose(got[1], move, atol=1e-5) and np.allclose(got[2], emit, atol=1e-5)


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.select("doc_id", "text").collect(), {r.doc_id: r for r in hmm.scored(docs).collect()}


def test_base_score(scored):
    rows, got = scored
    cut = {r.doc_id: [*r.text.encode().lower().split(), None] for r in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in cut}
    c = Counter(w for d, words in cut.items() if not held[d] for w in words)
    n, v = sum(c.values()), len(c)
    for d, words in cut.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words), sum(w in c for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)


def test_model_beats_base_on_held_out(scored):
    _, got = scored
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.9 * len(held)
    assert all(r.score <= 0 for r in got.values())


def plain_corpus(rows):
    """Documents as class sequences with ends, and training counts, restated."""
    cut = [[*(r.text or "").encode("utf-8", "replace").lower().split(), None] for r in rows]
    held = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 == 2 for r in rows]
    c = Counter(w for words, h in zip(cut, held) if not h for w in words)
    cls = lambda w: hmm.END if w is None else hmm.class_of(w)
    n_class, v_class = Counter(), Counter()
    for w, n in c.items():
        n_class[cls(w)] += n
        v_class[cls(w)] += 1
    return cut, held, c, cls, n_class, v_class


def plain_model(cut, held, cls, n_class):
    """The training restated: documents one by one, dense recursions."""
    background = np.array([n_class[k] + 0.5 for k in range(hmm.CLASSES)])
    background /= background.sum()
    way = hmm.directions()
    centre, k = background @ way, hmm.STATES
    seqs = [np.array([cls(w) for w in words]) for words, h in zip(cut, held) if not h]
    start, emit = np.zeros(k), np.zeros((hmm.CLASSES, k))
    for s in seqs:
        z = int((way[s].astype(float).mean(axis=0) - centre).argmax())
        start[z] += 1
        np.add.at(emit[:, z], s, 1)
    move = np.full((k, k), 0.1 / (k - 1)) + np.eye(k) * (0.9 - 0.1 / (k - 1))
    smooth = lambda e: (e + hmm.PRIOR * background[:, None]) / (e + hmm.PRIOR * background[:, None]).sum(axis=0)
    noise = np.random.default_rng(3).gamma(1.0, 1.0, emit.shape)
    emit = (emit + (hmm.PRIOR + emit.sum(axis=0) / 2) * background[:, None]) * (0.2 + noise)
    start, emit = (start + 1) / (start + 1).sum(), emit / emit.sum(axis=0)
    for _ in range(hmm.PASSES):
        s0, m0, e0 = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
        for s in seqs:
            n = len(s)
            a, scale, b = np.zeros((n, k)), np.zeros(n), np.ones((n, k))
            for t in range(n):
                x = (start if t == 0 else a[t - 1] @ move) * emit[s[t]]
                scale[t] = x.sum()
                a[t] = x / scale[t]
            for t in range(n - 2, -1, -1):
                b[t] = move @ (emit[s[t + 1]] * b[t + 1]) / scale[t + 1]
            g = a * b
            s0 += g[0]
            np.add.at(e0, s, g)
            for t in range(n - 1):
                m0 += np.outer(a[t], emit[s[t + 1]] * b[t + 1]) * move / scale[t + 1]
        start, move, emit = (s0 + 1) / (s0 + 1).sum(), (m0 + 1) / (m0 + 1).sum(axis=1, keepdims=True), smooth(e0)
    return start, move, emit


def plain_score(s, model):
    start, move, emit = model
    total, a = 0.0, None
    for t, c in enumerate(s):
        x = (start if t == 0 else a @ move) * emit[c]
        total += math.log10(x.sum())
        a = x / x.sum()
    return total


def test_query_score_by_a_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 3000).alias("text"))
    rows = docs.collect()
    cut, held, c, cls, n_class, v_class = plain_corpus(rows)
    model = plain_model(cut, held, cls, n_class)
    got = {r.doc_id: r for r in hmm.scored(docs).collect()}
    for r, words in zip(rows, cut):
        within = sum(math.log10((c[w] + 1) / (n_class[cls(w)] + v_class[cls(w)] + 1)) for w in words if w is not None)
        assert math.isclose(got[r.doc_id].score, plain_score([cls(w) for w in words], model) + within, rel_tol=1e-4), r.doc_id


def test_layout_changes_nothing(spark, monkeypatch):
    """Other partitions, blocks, slots and order of rows: the same scores."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    first = {r.doc_id: r for r in hmm.scored(docs).collect()}
    monkeypatch.setattr(hmm, "BLOCK", 3000)
    monkeypatch.setattr(hmm, "SLOT", 500)
    for r in hmm.scored(docs.repartition(7, F.reverse(F.col("doc_id").cast("string")))).collect():
        assert math.isclose(r.score, first[r.doc_id].score, rel_tol=1e-6)
        assert (r.n_known, r.n_tokens, r.train_tokens) == (first[r.doc_id].n_known, first[r.doc_id].n_tokens, first[r.doc_id].train_tokens)
        assert math.isclose(r.base_score, first[r.doc_id].base_score, rel_tol=1e-9)


def test_probabilities_of_the_next_word_sum_to_one(spark):
    """Over all known words, the end, and of each class one unknown word."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text")).collect()
    cut, held, c, cls, n_class, v_class = plain_corpus(rows)
    start, move, emit = plain_model(cut, held, cls, n_class)
    assert np.isclose(start.sum(), 1) and np.allclose(move.sum(axis=1), 1)
    for z in range(hmm.STATES):
        total = emit[hmm.END, z]
        for w in c:
            if w is not None:
                total += emit[cls(w), z] * (c[w] + 1) / (n_class[cls(w)] + v_class[cls(w)] + 1)
        total += sum(emit[k, z] / (n_class[k] + v_class[k] + 1) for k in range(hmm.END))
        assert math.isclose(total, 1, rel_tol=1e-9)
    assert hmm.class_of(b"of") != hmm.END and hmm.class_of(b"a" * 50) == hmm.class_of(b"b" * 50 + b"aaaa")


def test_odd_rows(odd, none):
    got = hmm.scored(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[3].n_tokens == by[4].n_tokens == 1 and by[8].n_tokens == 40_001
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert hmm.scored(none).count() == 0
