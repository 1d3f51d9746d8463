"""Helpers the corpus operators share: materialised tables, ids, words."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.tables import release, shared_dir
from framewright.functions.tables import write as materialize

__all__ = ["WORD", "bucket", "fresh", "join_labels", "lengths_of", "materialize", "numbered", "raw", "release", "shared_dir", "table"]

#: What separates words everywhere in this subpackage: ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with as many underscores more as make it new to ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; the id null counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def raw(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty, lone surrogates become '?'."""
    return b"" if text is None else text.encode("utf-8", "replace")


def lengths_of(parts: list) -> np.ndarray:
    """Lengths of a list's items."""
    return np.fromiter(map(len, parts), np.int64, len(parts))


def join_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes over edges (a, b).

    ``labels`` continues from earlier edges. Hooks roots onto smaller roots
    and halves paths until no edge joins two roots.
    """
    root = np.arange(n) if labels is None else labels
    while len(a):
        ra, rb = root[a], root[b]
        far = ra != rb
        a, b, ra, rb = a[far], b[far], ra[far], rb[far]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 0 on in ``order``, a total one.

    Rows are dealt by ranges and sorted in each task; a task's first place is
    the count of all before it, a row a task. ``rows`` should be a materialised
    table, as ranges are found by reading it once more.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = fresh(rows.columns, f"{name}_at")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed, _ = materialize(dealt.withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(at), 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row a task
    firsts, seen = [], 0
    for k, n in counts:
        firsts.append((k, seen))
        seen += n
    before, key = fresh(placed.columns, f"{name}_first"), fresh(placed.columns, f"{name}_part")
    found = placed.withColumn(key, part).join(F.broadcast(spark.createDataFrame(firsts, f"`{key}` long, `{before}` long")), key)
    return found.withColumn(name, F.col(before) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, before, key)
