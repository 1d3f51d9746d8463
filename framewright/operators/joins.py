"""Range, as-of and overlap joins on time.

Inequalities alone would make Spark compare all rows with all. Each helper
adds an equality on a time bucket, so that rows meet only their neighbours'
buckets, and hot keys are cut by time as well as by key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

SECOND = 1_000_000
#: Time that one window's partition spans in :func:`carried`.
CHUNK_US = 600 * SECOND
#: Time of one group of :func:`difference_counts` and :func:`nearest_in_time`.
NEAR_US = 600 * SECOND
#: Pairs looked at in one step.
PAIRS = 1 << 20


def range_join(left: DataFrame, right: DataFrame, on: list[str], at: str, low: int, high: int) -> DataFrame:
    """Rows whose ``right.at`` lies in ``[left.t + low, left.t + high]``.

    ``left`` has its time as ``t``; both share the columns ``on`` (null keys
    match nothing). Every left row looks into the few buckets of the width of
    the range that it can touch.
    """
    width = max(1, high - low)
    bucket = lambda x: F.floor(x / width).cast("long")
    wide = left.withColumn("__b", F.explode(F.sequence(bucket(F.col("t") + low), bucket(F.col("t") + high))))
    hit = wide.join(right.withColumn("__b", bucket(F.col(at))), [*on, "__b"]).drop("__b")
    return hit.where(F.col(at).between(F.col("t") + low, F.col("t") + high))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session has for a shuffle.

    For grouped functions whose work is much for the bytes they read, which
    would otherwise be put together by bytes, often into one task.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _near_chunks(left: DataFrame, right: DataFrame, on: list[str], reach_us: int, each: Callable[..., dict[str, np.ndarray]], by: list[str], more: str) -> DataFrame:
    """``each`` for rows of ``left`` of one chunk of time, with what is within
    reach of them in ``right``.

    It is given the rows' times in order, their numbers and their ``by`` (as
    places in a list), and times of ``right`` in order with running numbers; it
    gives a row's place as ``g`` and the columns ``more``.
    """
    chunk = lambda x: F.floor(x / NEAR_US).cast("long")
    rows = left.withColumn("__c", chunk(F.col("t")))
    there = right.select(*on, "air_us", "c", F.explode(F.sequence(chunk(F.col("air_us") - reach_us), chunk(F.col("air_us") + reach_us))).alias("__c"))
    kinds = dict(left.dtypes)
    names = [*by, *(c.split()[0] for c in more.split(", "))]

    def both(key: tuple, mine: pd.DataFrame, seen: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(seen):
            return pd.DataFrame(columns=names, dtype=object)
        mine, seen = mine.sort_values("t", ignore_index=True), seen.sort_values("air_us")
        place = mine.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        own = mine[by].iloc[np.unique(place, return_index=True)[1]].reset_index(drop=True)
        upto = np.concatenate([[0], seen["c"].to_numpy().cumsum()])
        found = each(mine["t"].to_numpy(dtype=float), mine["w"].to_numpy(), place, seen["air_us"].to_numpy(), upto)
        if not len(found["g"]):
            return pd.DataFrame(columns=names, dtype=object)
        return own.iloc[found.pop("g")].reset_index(drop=True).assign(**found)[names]

    return dealt(rows, *on, "__c").groupBy(*on, "__c").cogroup(dealt(there, *on, "__c").groupBy(*on, "__c")).applyInPandas(both, ", ".join([*(f"{c} {kinds[c]}" for c in by), more]))


def times(rows: DataFrame, keys: list[str], at: str, number: str) -> DataFrame:
    """Distinct times of each key and how many rows have them."""
    return rows.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.count("*").alias(number))


def difference_counts(left: DataFrame, right: DataFrame, on: list[str], by: list[str], reach_us: int, width_us: int) -> DataFrame:
    """Numbers ``n`` of pairs within reach, by ``bucket`` of their difference
    ``air_us - t`` (whole widths, towards zero), and the earliest pair of each.

    ``left``: ``by`` (with ``on`` among them), ``t`` and its number ``w``;
    ``right``: distinct times ``air_us`` with their number ``c``. No pair is
    written. Where there are more pairs than buckets they aren't looked at
    either: places of the buckets' edges tell how many lie between, so work
    grows with rows and buckets, however dense the times.
    """
    top = reach_us // width_us
    edges = [(-reach_us, "left"), *((k * width_us, "right") for k in range(-top, 0)), *((k * width_us, "left") for k in range(1, top + 1)), (reach_us, "right")]

    def dense(t: np.ndarray, w: np.ndarray, air: np.ndarray, upto: np.ndarray) -> list[tuple[int, int, float, int]]:
        out = []
        low = np.searchsorted(air, t + edges[0][0], side=edges[0][1])
        for bucket, (edge, side) in enumerate(edges[1:], -top):
            high = np.searchsorted(air, t + edge, side=side)
            n = int(((upto[high] - upto[low]) * w).sum())
            if n:
                at = int(np.argmax(high > low))
                out.append((bucket, n, t[at], air[low[at]]))
            low = high
        return out

    def each(t: np.ndarray, w: np.ndarray, place: np.ndarray, air: np.ndarray, upto: np.ndarray) -> dict[str, np.ndarray]:
        low, high = np.searchsorted(air, t - reach_us), np.searchsorted(air, t + reach_us, side="right")
        near, out = high - low, []
        if near.sum() > len(edges) * len(t):
            for g in range(place.max() + 1):
                mine = place == g
                out += [(g, *x) for x in dense(t[mine], w[mine], air, upto)]
            return dict(zip(("g", "bucket", "n", "first_t", "first_air"), map(np.array, zip(*out, strict=True)), strict=True))
        c = np.diff(upto)
        for rows in np.array_split(np.arange(len(t)), near.sum() // PAIRS + 1):
            row = np.repeat(rows, near[rows])
            there = np.arange(len(row)) - np.repeat(near[rows].cumsum() - near[rows], near[rows]) + low[row]
            key = place[row] * (2 * top + 1) + ((air[there] - t[row]) / width_us).astype(int) + top
            kind, first, of = np.unique(key, return_index=True, return_inverse=True)
            n = np.zeros(len(kind), dtype=np.int64)
            np.add.at(n, of, w[row] * c[there])
            out.append((kind // (2 * top + 1), kind % (2 * top + 1) - top, n, t[row[first]], air[there[first]]))
        return dict(zip(("g", "bucket", "n", "first_t", "first_air"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    parts = _near_chunks(left, right, on, reach_us, each, by, "bucket long, n long, first_t double, first_air long")
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("first_t").alias("t"), F.col("first_air").alias("air_us"))).alias("first"))


def nearest_in_time(left: DataFrame, right: DataFrame, on: list[str], by: list[str], reach_us: int) -> DataFrame:
    """``residual`` (``air_us - t``) to the nearest row within reach, of two as
    near the earlier, and the number ``w`` of ``left`` rows there."""

    def each(t: np.ndarray, w: np.ndarray, place: np.ndarray, air: np.ndarray, upto: np.ndarray) -> dict[str, np.ndarray]:
        at = np.searchsorted(air, t, side="right")
        before = np.where(at > 0, air[np.maximum(at - 1, 0)] - t, -np.inf)
        after = np.where(at < len(air), air[np.minimum(at, len(air) - 1)] - t, np.inf)
        residual = np.where(-before <= after, before, after)
        met = np.abs(residual) <= reach_us
        return {"g": place[met], "residual": residual[met], "w": w[met]}

    return _near_chunks(left, right, on, reach_us, each, by, "residual double, w long")


def _chunked(rows: DataFrame, keys: list[str], order: list[str], chunk_us: int) -> DataFrame:
    """Rows with their key as one column (nulls in it equal each other, and
    windows, sums and joins on it share one shuffle) and their chunk of time."""
    return rows.withColumns({"__k": F.struct(*keys), "__chunk": F.floor(F.col(order[0]) / chunk_us).cast("long")})


def carried(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, inclusive: bool = True, chunk_us: int = CHUNK_US) -> DataFrame:
    """The last non-null ``value`` at or (exclusively) before each row.

    An unbounded look-back over ``order`` (its first column is a time in
    microseconds) within ``keys``. Windows run over chunks of time, and what
    goes from chunk to chunk is one row a chunk, so that neither a busy key
    nor a long capture is one task's work.
    """
    cut = _chunked(rows.withColumn("__v", value), keys, order, chunk_us)
    within = Window.partitionBy("__k", "__chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    last = cut.groupBy("__k", "__chunk").agg(F.expr(f"max_by(__v, struct({', '.join(order)})) filter (where __v is not null)").alias("__last"))
    over = Window.partitionBy("__k").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("__k", "__chunk", F.last("__last", ignorenulls=True).over(over).alias("__before"))
    local = cut.withColumn("__local", F.last("__v", ignorenulls=True).over(within))
    return local.join(before, ["__k", "__chunk"]).select(*rows.columns, F.coalesce("__local", "__before").alias(name))


def islands(rows: DataFrame, keys: list[str], order: list[str], gap_us: int, name: str = "island", at_least: bool = False) -> DataFrame:
    """Numbers runs without a pause: the time each run began.

    A pause is longer than ``gap_us`` (with ``at_least``: that long). One pass:
    pauses within a chunk of time come from a window over it, and the edges of
    chunks, a row each, tell whether a chunk begins a run or goes on with the
    one before.
    """
    t = F.col(order[0])
    cut = _chunked(rows, keys, order, CHUNK_US)
    by = Window.partitionBy("__k", "__chunk").orderBy(*order)
    broken = (lambda wait: wait >= gap_us) if at_least else (lambda wait: wait > gap_us)
    marked = cut.withColumn("__start", F.when(broken(t - F.lag(t).over(by)), t))
    local = marked.withColumn("__local", F.last("__start", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edges = local.groupBy("__k", "__chunk").agg(F.min(t).alias("__first"), F.max(t).alias("__end"), F.max("__start").alias("__last"))
    over = Window.partitionBy("__k").orderBy("__chunk")
    wait = F.col("__first") - F.lag("__end").over(over)
    fresh = edges.withColumn("__fresh", F.when(wait.isNull() | broken(wait), F.col("__first")))
    before = F.last(F.coalesce("__last", "__fresh"), ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    entry = fresh.select("__k", "__chunk", F.coalesce("__fresh", before).alias("__entry"))
    return local.join(entry, ["__k", "__chunk"]).select(*rows.columns, F.coalesce("__local", "__entry").alias(name))


def numbered(rows: DataFrame, slice_us: int = CHUNK_US) -> DataFrame:
    """Rows (epoch_us, source, number) and their ``rank`` in capture order.

    From 1 on: a rank within a slice of time and the size of all slices before
    it, so no single task sorts the capture.
    """
    cut = rows.withColumn("__s", F.floor(F.col("epoch_us") / slice_us))
    sizes = cut.groupBy("__s").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__s").alias("__b"), (F.sum("__n").over(Window.orderBy("__s")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("epoch_us", "source", "number"))
    return cut.withColumn("__r", place).join(before, F.col("__s").eqNullSafe(F.col("__b"))).select(*rows.columns, (F.col("__r") + F.col("__before")).alias("rank"))


def by_rank(rows: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """Values at places (from 0, as columns over ``n``) of each group's order.

    Counts of distinct values add up along the order, so that a group's rows
    are never in one task, only its distinct values.
    """
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    line = Window.partitionBy(*keys).orderBy(value)
    upto = counts.withColumns({"__upto": F.sum("__c").over(line), "n": F.sum("__c").over(Window.partitionBy(*keys))})
    return upto.groupBy(*keys, "n").agg(*[F.min(F.when(F.col("__upto") > place, F.col(value))).alias(name) for name, place in places.items()])


def slices(runs: DataFrame, keys: list[str], fan: int = 1, slice_us: int = CHUNK_US) -> GroupedData:
    """Runs of :func:`islands` by the slice of time in which they began.

    For grouped functions whose state ends with a run, so that runs may follow
    one another: a group is a slice's worth of rows, of whole runs, rather
    than one call a run. ``keys`` stay together; with ``fan`` they share a
    slice with others of one hash.
    """
    began = F.floor(F.col("island") / slice_us).alias("slice")
    return runs.groupBy(*keys, began) if fan == 1 else runs.groupBy(F.pmod(F.xxhash64(*keys), F.lit(fan)).alias("part"), began)


def free(link: list[int], at: int) -> int:
    """The first place from ``at`` on that is free, by links that lead on."""
    end = at
    while link[end] != end:
        end = link[end]
    while link[at] != end:
        link[at], at = end, link[at]
    return end


def asof_backward(left: DataFrame, right: DataFrame, on: list[str], at: str, value: str, strict: bool = False) -> DataFrame:
    """``left`` with the ``value`` of the last ``right`` row up to its ``t``.

    ``strict`` leaves out rows of the same time.
    """
    both = left.withColumn("__side", F.lit(0 if strict else 2)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    seen = right.select(*on, F.col(at).alias("t"), value).withColumn("__side", F.lit(1))
    whole = both.unionByName(seen, allowMissingColumns=True)
    found = carried(whole, on, ["t", "__side"], F.when(F.col("__side") == 1, F.col(value)), "__found")
    return found.where("__side <> 1").select(*left.columns, F.col("__found").alias(value))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], width_us: int = 10 * SECOND) -> DataFrame:
    """Pairs of intervals ``[l_start, l_end]`` and ``[r_start, r_end]`` that meet.

    Each interval is listed in the buckets it covers; a pair is kept in the
    first bucket that both cover only.
    """
    spread = lambda df, a, b: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(a) / width_us).cast("long"), F.floor(F.col(b) / width_us).cast("long"))))
    pairs = spread(left, "l_start", "l_end").join(spread(right, "r_start", "r_end"), [*on, "__b"])
    first = F.col("__b") == F.floor(F.greatest("l_start", "r_start") / width_us)
    return pairs.where(first & (F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end"))).drop("__b")
