"""A byte-level convolutional classifier of whole documents.

A document's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters slide over embedded bytes; each filter's largest activation in
a chunk is a feature, a chunk's features give a log odds, and the document's
probability is that of the chunks' mean log odds.

It is trained on the driver on a bounded sample: at most ``SAMPLE`` labelled
documents of each label and ``SAMPLE_BYTES`` of text in all, those with the
smallest hash of their id, from the training folds only. Scoring is row-wise in Arrow batches and never shuffles.

Defined cases: null and empty texts are one chunk of padding and get a score
like any other; with no labels, or one label only, every score is that label's
share (0.5 with none); repeated label rows count once an id (the higher label),
of rows of one id the shortest text trains; very long texts are scored whole,
but don't train where they exceed what is left of the sample's bytes; equal
texts score alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import bucket, raw

CHUNK, STEP = 512, 448
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 4, 16
#: Labelled documents of each label that training may take, and their bytes.
SAMPLE, SAMPLE_BYTES = 1000, 64 << 20
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 1e-4
FOLDS, HELD = 5, 0
THRESHOLD = 0.3
#: Chunks convolved at once.
AT_ONCE = 128


def chunks(text: str | None) -> np.ndarray:
    """The overlapping chunks of one text, zero-padded."""
    data = np.frombuffer(raw(text), np.uint8)
    n = max(1, -(-(len(data) - CHUNK) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class ConvNet:
    """Filters over bytes; parameters in ``self.p``."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.p = parameters or {
            "embed": rng.normal(0, 0.5, (256, EMBED)),
            "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.3, FILTERS),
            "shift": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _patches(self, x: np.ndarray) -> np.ndarray:
        seen = self.p["embed"][x]  # chunk, byte, embed
        view = np.lib.stride_tricks.sliding_window_view(seen, WIDTH, axis=1)[:, ::STRIDE]  # chunk, place, embed, width
        return view.reshape(len(x), -1, WIDTH * EMBED)

    def features(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest activations of chunks, their places, and all patches."""
        patches = self._patches(x)
        hidden = patches @ self.p["filters"] + self.p["bias"]
        at = hidden.argmax(axis=1)
        return np.maximum(np.take_along_axis(hidden, at[:, None], axis=1)[:, 0], 0), at, patches

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of chunks."""
        out = np.empty(len(x), np.float32)
        for a in range(0, len(x), AT_ONCE):
            hidden = self._patches(x[a : a + AT_ONCE]) @ self.p["filters"]
            top = np.maximum(hidden.max(axis=1) + self.p["bias"], 0)
            out[a : a + AT_ONCE] = top @ self.p["out"] + self.p["shift"]
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities of documents."""
        out, run, size = [], [], []

        def flush() -> None:
            z = self.odds(np.concatenate(run)).astype(np.float64)
            begin = np.cumsum(size) - size
            out.append(1 / (1 + np.exp(-np.clip(np.add.reduceat(z, begin) / size, -30, 30))))
            run.clear()
            size.clear()

        for t in texts:
            c = chunks(t)
            run.append(c)
            size.append(len(c))
            if sum(size) >= 4 * AT_ONCE:
                flush()
        if run:
            flush()
        return np.concatenate(out) if out else np.zeros(0)

    def gradient(self, x: np.ndarray, owner: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss of documents; ``owner``: each chunk's document."""
        p = self.p
        top, at, patches = self.features(x)
        n = np.bincount(owner, minlength=len(label))
        z = np.bincount(owner, weights=top @ p["out"] + p["shift"], minlength=len(label)) / n
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / (len(label) * n))[owner].astype(np.float32)
        active = dz[:, None] * p["out"] * (top > 0)
        seen = np.take_along_axis(patches, at[:, :, None], axis=1)  # chunk, filter, embed x width
        inner = (active[:, :, None] * p["filters"].T).reshape(len(x), FILTERS, EMBED, WIDTH).swapaxes(2, 3)
        places = at[:, :, None] * STRIDE + np.arange(WIDTH)
        read = np.take_along_axis(x, places.reshape(len(x), -1), axis=1).reshape(-1)
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, read, inner.reshape(-1, EMBED))
        return {"embed": embed, "filters": np.einsum("cf,cfk->kf", active, seen), "bias": active.sum(axis=0), "out": dz @ top, "shift": dz.sum(keepdims=True)}

    def fit(self, texts: list[str | None], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> ConvNet:
        """Adam over shuffled batches of whole documents."""
        cut = [chunks(t) for t in texts]
        rng, step = np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for _ in range(epochs):
            order = rng.permutation(len(cut))
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                owner = np.repeat(np.arange(len(own)), [len(cut[i]) for i in own])
                step += 1
                for k, g in self.gradient(np.concatenate([cut[i] for i in own]), owner, labels[own]).items():
                    g = g + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str | None, int]]:
    """(text, label) of at most ``sample`` labelled documents a label.

    Only ids outside the held-out fold; a fixed order of their hashes decides.
    """
    usable = labels.where((bucket(F.col("doc_id"), FOLDS) != HELD) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    once = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.select(F.col("doc_id"), F.col("text"))
    # Ids first, without texts: of a label only those with the smallest hashes, which is a bounded table.
    known = once.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    by_id = {r["doc_id"]: r["quality"] for r in chosen}
    if not by_id:
        return []
    spark, key = docs.sparkSession, docs.select("doc_id").schema
    size = F.min(F.octet_length(F.coalesce("text", F.lit("")))).alias("size")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    room, some = SAMPLE_BYTES, []
    of = lambda ids: texts.join(F.broadcast(spark.createDataFrame([(d,) for d in ids], key)), "doc_id", "left_semi")
    for r in of(by_id).groupBy("doc_id").agg(size).orderBy(*order).collect():  # ids and sizes of at most two samples
        if r["size"] <= room:
            room -= r["size"]
            some.append(r["doc_id"])
    if not some:
        return []
    best = of(some).withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))).groupBy("doc_id").agg(F.min_by("text", F.struct("size", "text")).alias("text"))
    return [(r["text"], int(by_id[r["doc_id"]])) for r in best.orderBy(*order).collect()]


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ConvNet:
    """The classifier of ``docs``, learned from ``labels``."""
    rows = training_rows(docs, labels, sample)
    y = np.array([q for _, q in rows], np.float64)
    if not rows or y.min() == y.max():
        net = ConvNet()
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        net.p["out"] = np.zeros(FILTERS, np.float32)
        net.p["shift"] = np.array([np.log(share / (1 - share))], np.float32)
        return net
    return ConvNet().fit([t for t, _ in rows], y)


def probability(text: Column, net: ConvNet) -> Column:
    """A text column as probabilities of label 1."""
    parameters = net.p  # a few kB, whatever the corpus

    @F.pandas_udf("double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = ConvNet(parameters)
        for part in parts:
            yield pd.Series(own.score(part.tolist()))

    return judge(text)
