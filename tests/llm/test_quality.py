import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import quality
from framewright.llm.queries import op6_quality


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    net = quality.ConvNet()
    cut = [quality.chunks("abc " * 300), quality.chunks("XYZ!! " * 40)]
    x, owner, y = np.concatenate(cut), np.repeat([0, 1], [len(c) for c in cut]), np.array([1.0, 0.0])

    def loss():
        z = [net.odds(c).astype(float).mean() for c in cut]
        return np.mean([np.log1p(np.exp(-v)) if t else np.log1p(np.exp(v)) for v, t in zip(z, y)])

    found = net.gradient(x, owner, y)
    for k in ("out", "bias", "shift", "filters", "embed"):
        at = tuple(rng.integers(0, n) for n in net.p[k].shape) if k != "embed" else (ord("a"), 1)
        keep, e = net.p[k][at], 1e-2
        net.p[k][at] = keep + e
        up = loss()
        net.p[k][at] = keep - e
        down = loss()
        net.p[k][at] = keep
        assert abs((up - down) / (2 * e) - found[k][at]) < 5e-3


def plain_score(text, p):
    """The forward pass restated, byte by byte and filter by filter."""
    data = (text or "").encode()
    starts = [0]
    while starts[-1] + quality.CHUNK < len(data):
        starts.append(starts[-1] + quality.STEP)
    odds = []
    for s in starts:
        chunk = data[s : s + quality.CHUNK].ljust(quality.CHUNK, b"\0")
        seen = [p["embed"][b].astype(float) for b in chunk]
        top = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            patch = np.array([seen[at + k][e] for e in range(quality.EMBED) for k in range(quality.WIDTH)])
            top = np.maximum(top, patch @ p["filters"] + p["bias"])
        odds.append(np.maximum(top, 0) @ p["out"] + p["shift"][0])
    return 1 / (1 + np.exp(-np.clip(np.mean(odds), -30, 30)))


def test_query_by_a_plain_forward_pass(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = quality.trained(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r for r in op6_quality(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::5] + sorted(rows, key=lambda r: -len(r.text or ""))[:2]:
        want = plain_score(r.text, net.p)
        assert abs(got[r.doc_id].score - want) < 1e-4, r.doc_id
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_long_and_repeated_texts(spark, odd, tmp_path):
    """Through the query: chunks at every boundary, a very long text, copies."""
    texts = ["a" * n for n in (0, 511, 512, 513, 960, 961)] + ["Words and more. " * 100_000, None, "copy", "copy"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1), (2, 1), (3, 0), (8, 0), (9, 1), (6, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r.doc_id: r.score for r in op6_quality(spark, str(tmp_path)).collect()}
    net = quality.trained(*(spark.read.parquet(str(tmp_path / f"{t}.parquet")) for t in ("documents", "labels")))
    assert len(got) == len(texts) and got[8] == got[9] and got[0] == got[7]
    for k, t in enumerate(texts):
        if t is None or len(t) < 2000:
            assert abs(got[k] - plain_score(t, net.p)) < 1e-4


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "x" * (10 if k % 3 else 5000)) for k in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 4000)
    rows = quality.training_rows(docs, labels)
    assert rows and sum(len(t) for t, _ in rows) <= 4000 and {q for _, q in rows} == {0, 1}


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        seen = quality.chunks("".join(chr(33 + i % 90) for i in range(n)))
        whole = np.concatenate([seen[0], *(c[-quality.STEP :] for c in seen[1:])]) if len(seen) > 1 else seen[0]
        assert bytes(whole[:n]).decode() == "".join(chr(33 + i % 90) for i in range(n))


def test_held_out_accuracy(spark):
    got = op6_quality(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    clean, junk = (held.where(F.col("quality") == q) for q in (1, 0))
    assert clean.where("predicted = 1").count() >= 0.97 * clean.count()
    assert junk.where("predicted = 0").count() >= 0.85 * junk.count()


@pytest.mark.parametrize("labels", ["select 1L doc_id, 1 quality where false", "select doc_id, 1 quality from range(9) t(doc_id)", "select null doc_id, 0 quality"])
def test_few_labels(spark, odd, labels):
    net = quality.trained(odd, spark.sql(labels).selectExpr("cast(doc_id as long) doc_id", "quality"))
    got = [r[0] for r in odd.select(quality.probability(F.col("text"), net)).collect()]
    assert len(set(got)) == 1 and 0 <= got[0] <= 1


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 0), (9, 0), (9, 0), (None, 1)], "doc_id long, quality int")
    net = quality.trained(odd, labels)
    got = odd.select(quality.probability(F.col("text"), net).alias("s")).collect()
    assert len(got) == odd.count() and all(0 <= r.s <= 1 for r in got)
    assert none.select(quality.probability(F.col("text"), net)).count() == 0
    assert quality.training_rows(none, labels) == []
