import re
from collections import Counter

import numpy as np
import pytest

from framewright.llm import rules
from framewright.llm.queries import op8_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def vector(text):
    n, chars, sym, dup, rep = brute(text)
    return np.log(chars / n), np.sqrt(sym / chars), np.sqrt(dup / n), np.sqrt(rep / n)


def brute_floor(passed, all_x0):
    """The least deviations of a group, from its texts and all word lengths."""
    words, chars = (sorted(brute(t)[k] for t in passed)[(len(passed) + 1) // 2 - 1] for k in (0, 1))
    most = [r * 0.95**2 / rules.chi_squared(4, rules.TAIL) for r in (1, 1, 0.3)]
    return np.sqrt([np.var(all_x0) / 4, min(1 / chars, most[0]), min(1 / words, most[1]), min(8 / words, most[2])])


def brute_search(x, floor, starts=150):
    """The least determinant of row-wise concentration from many starts."""
    h, rng, best = (len(x) + 5) // 2, np.random.default_rng(3), None
    for k in range(starts):
        some = x if k == 0 else x[rng.choice(len(x), 5, replace=False)]
        mean, cov, volume = some.mean(axis=0), np.cov(some.T, bias=True), np.inf
        while True:
            p = np.linalg.inv(cov + np.diag(floor**2))
            near = x[np.argsort(np.einsum("ni,ij,nj->n", x - mean, p, x - mean), kind="stable")[:h]]
            new = np.linalg.slogdet(np.cov(near.T, bias=True) + np.diag(floor**2))[1]
            if new >= volume - 1e-9:
                break
            mean, cov, volume = near.mean(axis=0), np.cov(near.T, bias=True), new
        if best is None or volume < best[0]:
            best = volume, mean, cov
    volume, mean, cov = best
    d = np.sort(np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov + np.diag(floor**2)), x - mean))[h - 1]
    return volume, mean, cov * max(1, d / rules.chi_squared(4, 0.5)) + np.diag(floor**2)


@pytest.fixture(scope="module")
def judged(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    return docs, {r.doc_id: r for r in op8_rules(spark, d).collect()}


def test_statistics(judged):
    docs, got = judged
    for i, d in docs.items():
        assert tuple(got[i][c] for c in rules.STATS) == brute(d.text)
        n, _, _, _, rep = brute(d.text)
        assert got[i].base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (got[i].base_failed and got[i].kept)


def test_verdicts_are_those_of_the_least_determinant(judged):
    """Against rows one by one, over whole languages (sources are small here)."""
    docs, got = judged
    for lang in {d.lang for d in docs.values()}:
        own = {i: d for i, d in docs.items() if d.lang == lang}
        assert max(Counter(d.source for i, d in own.items() if not got[i].base_failed).values()) <= rules.LEAST
        passed = {i: d.text for i, d in own.items() if not got[i].base_failed}
        x = np.array([vector(t) for t in passed.values()])
        if len(x) < rules.LEAST:
            assert all(got[i].kept and got[i].distance is None for i in passed)
            continue
        volume, mean, cov = brute_search(x, brute_floor(list(passed.values()), [np.log(max(b[1], 1) / max(b[0], 1)) for b in (brute(d.text) for d in own.values())]))
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        mine = np.array([got[i].distance for i in passed])
        same = np.array([got[i].kept for i in passed]) == (d <= rules.chi_squared(4, rules.TAIL))
        assert np.mean(same) >= 0.995 and np.all(np.abs(mine - d) <= 0.3 + 0.2 * d), lang


def test_half_of_least_determinant_from_cells():
    """Cells of one row each: as low as rows one by one, the half exact, ties shared."""
    rng = np.random.default_rng(5)
    far = rng.normal(3, 0.2, (140, 4))
    x = np.concatenate([rng.normal(0, (0.5, 0.3, 0.2, 0.1), (160, 4)), far])
    floor = np.full(4, 1e-3)
    half = rules.Half(np.ones(300), x, np.einsum("ni,nj->nij", x, x), floor)
    mean, cov, volume = half.best()
    assert volume <= brute_search(x, floor)[0] + 1e-6
    assert half.size == 152 and np.abs(mean).max() < 0.3  # not drawn to the 140 far rows
    assert np.mean(np.einsum("ni,ij,nj->n", far - mean, np.linalg.inv(cov), far - mean) > rules.chi_squared(4, 0.001)) == 1
    ties = rules.Half(np.array([3.0, 5.0, 7.0]), np.array([[3.0] * 4, [10.0] * 4, [21.0] * 4]), np.ones((3, 4, 4)), floor)
    share = np.zeros(3)
    assert ties.size == 10
    m, _, _ = ties.step(np.array([1.0] * 4), np.eye(4))
    assert np.allclose(m, (3 * 1 + 5 * 2 + 2 * 3) / 10) and share.sum() == 0


def test_estimates_by_language_and_source(spark):
    """On the 0.1 tables every source is large enough for an estimate of its own."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    stats = docs.select("doc_id", "lang", "source", rules.measured(docs.text).alias("stats"))
    rows = rules.judged(stats).select("doc_id", "lang", "source", "verdict.*").collect()
    passed = [r for r in rows if not r.base_failed]
    large = {k for k, n in Counter((r.lang, r.source) for r in passed).items() if n > rules.LEAST}
    assert len(large) >= 60 and all(r.distance is not None for r in passed)
    clean = [r for r in passed if labels.get(r.doc_id) == 1]
    junk = [r for r in passed if labels.get(r.doc_id) == 0]
    assert sum(not r.kept for r in clean) <= 0.003 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.95 * len(junk)
    for key in large:
        own = [r for r in clean if (r.lang, r.source) == key]
        assert sum(not r.kept for r in own) <= max(1, 0.02 * len(own)), key


def test_own_group_of_a_large_source(spark):
    clean = " ".join(f"word{i % 50:02d}" for i in range(30))
    long = " ".join(f"longerword{i:02d}" for i in range(30))
    rows = [(k, "en", "big", f"{k} " + clean) for k in range(80)] + [(99, "en", "big", long)] + [(200 + k, "en", "other", f"{k} {long}") for k in range(90)] + [(100, "en", "small", clean), (101, "xx", "small", clean)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    got = {r.doc_id: r.verdict for r in rules.judged(docs.withColumn("stats", rules.measured(docs.text))).collect()}
    assert len(got) == len(rows) and all(got[k].kept for k in range(80)) and all(got[200 + k].kept for k in range(90))
    assert got[99].distance > 4 * max(got[200 + k].distance for k in range(90))  # common in one source, odd in the other
    assert got[100].distance is not None  # by its language
    assert got[101].kept and got[101].distance is None


def test_each_coordinate_alone_rejects(spark):
    word = lambda k, n=5: f"{k:0{n}d}"
    clean = [" ".join(word(100 * k + i, 5 + (k + i) % 2) for i in range(100)) for k in range(80)]
    far = {
        "long words": " ".join(word(i, 9) for i in range(100)),
        "symbols": " ".join(word(i, 5) if i % 2 else word(i, 4) + "&" for i in range(100)),
        "repeated lines": "".join("end\n" if i % 5 == 4 else word(i) + " \n"[i % 5 == 3] for i in range(100)),
        "repeated words": " ".join(word(i % 86) for i in range(100)),
    }
    docs = spark.createDataFrame([(str(k), "en", "big", t) for k, t in enumerate(clean)] + [(k, "en", "big", t) for k, t in far.items()], "doc_id string, lang string, source string, text string")
    got = {r.doc_id: r.verdict for r in rules.judged(docs.withColumn("stats", rules.measured(docs.text))).collect()}
    assert all(got[str(k)].kept for k in range(80))
    for k in far:
        assert not got[k].base_failed and not got[k].kept, k


def test_clean_documents_stay(spark, judged):
    docs, got = judged
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    judged_clean = [got[r.doc_id] for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    assert sum(r.kept for r in judged_clean) >= 0.99 * len(judged_clean)


def test_chi_squared():
    assert abs(rules.chi_squared(4, 0.05) - 9.488) < 0.05 and abs(rules.chi_squared(4, 0.001) - 18.467) < 0.1


def test_repeats_of_random_words():
    rng = np.random.default_rng(1)
    for _ in range(20):
        words = [str(x) for x in rng.integers(0, 2, rng.integers(0, 60))]
        text = " ".join(words)
        assert rules.statistics([text, None, text]).n_repeat_words.tolist() == [brute(text)[4], 0, brute(text)[4]]


def test_odd_rows(odd, none):
    for docs in (odd, none):
        got = rules.judged(docs.withColumn("stats", rules.measured(docs.text)))
        assert got.columns == [*docs.columns, "stats", "verdict"] and got.count() == docs.count()
        assert all(r.verdict.base_failed and not r.verdict.kept for r in got.where("doc_id in (3, 4, 5)").collect())
