import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np

from framewright.llm import resampling
from framewright.llm.queries import ORACLES, op11_resampling


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def brute(docs, target):
    """Plain restatement: a dictionary a document, whole numbers of Python."""
    s, t = (Counter(zlib.crc32(w) % 10_000 for _, x in rows for w in words(x)) for rows in (docs, target))
    big, small = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big + 10_000) / ((s[b] + 1) * (small + 10_000)))) for b in s}
    out = []
    for i, x in docs:
        found = [gain[zlib.crc32(w) % 10_000] for w in words(x)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(found) // len(found) if found else 0
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 10 // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def test_plane_sums_are_exact():
    rng = np.random.default_rng(3)
    for top in (1, 2, 1000, 1 << 40):
        counts, gain = rng.integers(0, top, resampling.BUCKETS), rng.integers(0, 40_000, resampling.BUCKETS)
        assert resampling.plane_sum(resampling.planes(counts), resampling.planes(gain)) == sum(a * b for a, b in zip(counts.tolist(), gain.tolist(), strict=True))
    zero = np.zeros(resampling.BUCKETS, np.int64)
    assert resampling.plane_sum(resampling.planes(zero), resampling.planes(zero)) == 0


def test_odd_rows(spark, odd, none):
    target = odd.select("doc_id", "text").where("doc_id > 5")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(resampling.resampled(odd, target)) == brute(docs, [x for x in docs if (x[0] or 0) > 5])
    assert resampling.resampled(none, target).count() == 0
    assert got(resampling.resampled(odd, target.where("false"))) == brute(docs, [])


def test_a_third_are_copies(spark):
    rng = random.Random(5)
    pool = ["Wort", "été", "x1", "the", "THE", "東京", "a_b", "q"]
    docs = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, "the same text of copies " * 9) for i in range(200)] + [(7, docs[7][1])] * 3
    target = [(1, "THE target étés of x1"), (2, None), (3, "copies")]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    found = got(resampling.resampled(frame(docs), frame(target)))
    assert found == brute(docs, target)
    assert sum(r[4] is not None for r in found) == sum(r[1] >= 20 for r in found) * 10 // 100


def test_a_text_longer_than_a_piece(monkeypatch):
    text = "long words and others, again " * 300
    whole = resampling.counts_of(text)
    monkeypatch.setattr(resampling, "_AT_ONCE", 64)
    assert (resampling.counts_of(text) == whole).all() and whole.sum() == 1500


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    for t in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(duckdb.sql(ORACLES["op11_resampling"]).select("doc_id, n_features, weight, score, rank").fetchall(), key=repr)
    assert got(op11_resampling(spark, d)) == want
