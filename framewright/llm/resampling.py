"""Target-distribution importance resampling over bit-sliced counts.

Every document is a vector of hashed word counts. Its words' counts become bit
planes: plane k has a bit for each of the buckets, set where bit k of the
bucket's count is. The buckets' gains, how much likelier a bucket is in the
target than in the corpus, are sliced the same way, their magnitudes once for
gains above zero and once for those below. A document's summed gain is then a
sum over pairs of planes of ``2^(k+j)`` times the bits that both have, in whole
numbers and so exact, whatever the order. Documents are drawn without
replacement by adding a Gumbel deviate of the id's hash to the mean gain and
taking the highest.

Counts of the corpus and the target are sums over all rows: a task sends one
row a bucket at most, so that a word's share of all rows doesn't matter. What
reaches the driver are ``BUCKETS`` sums, whatever the input. Ranks come from a
sort dealt to tasks by ranges of (score, id), never from one task.

Defined cases: null or wordless text has no features, weight 0 and its own
deviate; a null id counts as the id of no digits and comes last among ties;
repeated rows and equal ids are rows of their own and their ties are broken
arbitrarily, as their ids are the same; very long texts are read whole; an
empty corpus gives no rows and an empty target gains from add-one counts; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import materialize, numbered, raw

BUCKETS = 10_000
#: Bits of a plane, in whole 64-bit words.
_WORDS = -(-BUCKETS // 64)
SEED = 2024
LEAST_WORDS, DRAWN_PERCENT = 20, 10
#: Words of one text that are held at once as Python strings.
_AT_ONCE = 1 << 22
#: Bytes of a word are digits, a-z and all beyond ASCII; A-Z are lowered.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def counts_of(text: str | None) -> np.ndarray:
    """How often each bucket occurs among one text's words."""
    data, found, at = raw(text).translate(_FOLD), np.zeros(BUCKETS, np.int64), 0
    while at < len(data):
        end = data.find(b" ", at + _AT_ONCE)
        end = len(data) if end < 0 else end
        hashed = [zlib.crc32(w) for w in data[at:end].split()]
        found += np.bincount(np.array(hashed, np.int64) % BUCKETS, minlength=BUCKETS)
        at = end
    return found


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers from zero on: row k holds the k-th bits."""
    depth = int(values.max(initial=0)).bit_length()
    bits = np.zeros((depth, _WORDS * 64), np.uint8)
    for k in range(depth):
        bits[k, : len(values)] = (values >> k) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def plane_sum(counts: np.ndarray, gains: np.ndarray) -> int:
    """Sum of counts times gains from their planes: bits both have, weighed."""
    if not len(counts) or not len(gains):
        return 0
    both = np.bitwise_count(counts[:, None, :] & gains[None, :, :]).sum(axis=2, dtype=np.int64)
    return sum(int(n) << (k + j) for (k, j), n in np.ndenumerate(both))


def bucket_sums(rows: DataFrame, text: str) -> np.ndarray:
    """How often each bucket occurs over all rows."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for part in parts:
            for t in part["text"]:
                total += counts_of(t)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    each = rows.select(F.col(f"`{text}`").alias("text")).mapInPandas(partial, "bucket int, n long")
    found = np.zeros(BUCKETS, np.int64)
    for row in each.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        found[row.bucket] = row.n
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a natural logarithm, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(text: Column, gain: np.ndarray) -> Column:
    """n_features and weight (the mean gain, rounded down) of texts."""
    up, down = planes(np.maximum(gain, 0)), planes(np.maximum(-gain, 0))

    @F.pandas_udf("n_features long, weight long")
    def weighed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part:
                counts = counts_of(t)
                n, sliced = int(counts.sum()), planes(counts)
                rows.append((n, (plane_sum(sliced, up) - plane_sum(sliced, down)) // n if n else 0))
            yield pd.DataFrame(rows, columns=["n_features", "weight"])

    return weighed(text)


def deviate(doc_id: Column) -> Column:
    """Gumbel deviate of an id in thousandths, rounded down."""
    named = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of all rows.

    Of the rows with at least ``LEAST_WORDS`` words, ``DRAWN_PERCENT`` percent
    are drawn, the highest scores first and among equal scores smaller ids.
    """
    gain = gains(bucket_sums(docs, text), bucket_sums(target, target_text))
    weighed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), weights(F.col(f"`{text}`"), gain).alias("r")).select("doc_id", "r.*")
    scored = weighed.withColumn("score", F.col("weight") + deviate(F.col("doc_id"))).withColumn("row", F.monotonically_increasing_id())
    rows, _ = materialize(scored, "scored")
    able = rows.where(F.col("n_features") >= LEAST_WORDS)
    drawn = able.count() * DRAWN_PERCENT // 100
    ranked = numbered(able, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], "place")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    others = rows.where(F.col("n_features") < LEAST_WORDS)
    own = ("doc_id", "n_features", "weight", "score")
    return ranked.select(*own, rank).unionByName(others.select(*own, F.lit(None).cast("long").alias("rank")))
