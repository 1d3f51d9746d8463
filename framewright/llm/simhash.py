"""SimHash near-duplicates by a binary trie's self-join.

Fingerprints are sorted integers, so a trie node at depth d is a contiguous
range that shares its top d bits. The join walks pairs of nodes together: a
pair's children on the same side keep the pair's number of differing bits,
children on opposite sides add one, and a pair beyond the error budget is
pruned. No pair of documents is ever formed outside the budget, and a
fingerprint has at most 1 + 64 + 2016 neighbours within two bits, so the
work per distinct fingerprint is bounded however large a group of copies is.

On a cluster the trie is walked in as many orders of bits as the budget plus
one. The bits are cut into that many blocks; a pair within the budget agrees on
one block at least, so in the order that begins with that block its nodes part
only below it. Each order is therefore dealt to groups by its first block
alone, a fingerprint goes to three groups whatever their number, and groups
hold about ``LEAF`` fingerprints. Where one value of a block has more, its
fingerprints are dealt anew by blocks of the bits that are left, and so on:
distinct fingerprints that share 48 bits can't be more than ``LEAF``, so every
group is bounded.

Equal fingerprints are collapsed before the join, so exact copies cost one row;
the results return to them by a join that spreads the commonest fingerprints
over many keys. Each group returns a spanning forest of its links, never the
links themselves; stars over the forest give components.

Defined cases: null or wordless text has fingerprint zero and links like any
other; repeated rows and equal ids are rows of their own; a component whose
ids are all null has component_id null; very long texts are read whole; an
empty table gives no rows; other columns are ignored by :func:`components`.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import join_labels, lengths_of, materialize, raw, release

BUDGET = 2
SEED = 42
SHINGLE = 3
#: Fingerprints in a group of the distributed trie, and least groups an order.
LEAF = 1 << 16
LEAST_GROUPS = 16
#: A fingerprint is spread that has more than one in so many of all rows, over
#: so many keys.
HOT_SHARE, SALTS = 1000, 64
#: Node pairs expanded at once, and element pairs compared without descent.
FRONTIER, BRUTE = 1 << 18, 16
_LANES = np.uint64(0x0101010101010101)


def hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of every word shingle of one text, repeats included."""
    words = raw(text).lower().split()
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    flat = b" ".join(words)
    ends = np.cumsum(lengths_of(words) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(flat[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]


def fingerprint_of(values: list[int]) -> int:
    """Bits set in over half of the values; by byte lanes, 255 rows a lane."""
    n = len(values)
    if not n:
        return 0
    h = np.array(values, np.uint64)
    counts = np.zeros(64, np.int64)
    cuts = np.arange(0, n, 255)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, cuts)
        counts[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long column more."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint_of(hashes(t)) for t in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.withColumn(name, simhash(F.col(text)))


def _split(a: np.ndarray, lo: np.ndarray, bit: int) -> np.ndarray:
    """First index at or after ``lo`` whose value has ``bit`` set, in a node."""
    high = np.uint64((~((1 << (bit + 1)) - 1)) & (2**64 - 1))
    return np.searchsorted(a, (a[lo] & high) | np.uint64(1 << bit))


def trie_join(a: np.ndarray, b: np.ndarray | None = None, budget: int = BUDGET, exact: int = 0, bits: int = 64, brute: int = BRUTE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted ``a`` and ``b`` within the budget.

    Without ``b`` the trie joins itself and each pair comes once, i < j. The
    first ``exact`` bits must agree: nodes part only below them. Bits beyond
    the first ``bits`` don't count. Nodes with up to ``brute`` pairs of elements
    are compared at once: more for a wide budget, which prunes late.
    """
    itself = b is None
    b = a if itself else b
    if not len(a) or not len(b):
        return
    stack = [(0, np.array([[0], [len(a)], [0], [len(b)], [0]]))]
    while stack:
        d, f = stack.pop()
        if f.shape[1] > FRONTIER:
            half = f.shape[1] // 2
            stack += [(d, f[:, :half]), (d, f[:, half:])]
            continue
        alo, ahi, blo, bhi, e = f
        small = (ahi - alo) * (bhi - blo) <= brute
        if d >= bits:  # what is left of a node agrees: halves, until few pairs are formed at once
            small = (ahi - alo) * (bhi - blo) <= FRONTIER
            for x in f[:, ~small].T.tolist():
                i, j = (x[0] + x[1]) // 2, (x[2] + x[3]) // 2
                quarters = [(x[0], i, x[2], j), (x[0], i, j, x[3]), (i, x[1], j, x[3])] + [(i, x[1], x[2], j)] * (not itself or x[0] != x[2])
                stack += [(d, np.array([[*q, x[4]]]).T) for q in quarters if q[0] < q[1] and q[2] < q[3]]
            f, small = f[:, small], small[small]
            alo, ahi, blo, bhi, e = f
        if small.any():
            x, w = f[:, small], (bhi - blo)[small]
            n = (ahi - alo)[small] * w
            at = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            i, j = x[0][at] + k // w[at], x[2][at] + k % w[at]
            off = a[i] ^ b[j]
            keep = np.bitwise_count(off >> np.uint64(64 - bits)) <= budget
            if exact:
                keep &= off >> np.uint64(64 - exact) == 0
            if itself:
                keep &= i < j
            if keep.any():
                yield i[keep], j[keep]
        f = f[:, ~small]
        if not f.shape[1]:
            continue
        alo, ahi, blo, bhi, e = f
        amid = np.minimum(_split(a, alo, 63 - d), ahi)
        bmid = np.minimum(_split(b, blo, 63 - d), bhi)
        new = [np.stack([alo, amid, blo, bmid, e]), np.stack([amid, ahi, bmid, bhi, e])]
        if d >= exact:
            same = (alo == blo) & (ahi == bhi) if itself else np.zeros(len(alo), bool)
            new += [np.stack([alo, amid, bmid, bhi, e + 1]), np.stack([amid, ahi, blo, bmid, e + 1])[:, ~same]]
        new = np.concatenate(new, axis=1)
        new = new[:, (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= budget)]
        if new.shape[1]:
            stack.append((d + 1, new))


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (fp, path, exact, p) once for each block of their free bits.

    ``p`` has the bits of ``fp`` in another order, of which the first ``exact``
    are those that fellows of a group share; the block comes next, turned to
    the front of what is left.
    """
    rest = "(64 - exact)"
    low = f"(p & case when exact = 0 then -1L else shiftleft(1L, {rest}) - 1 end)"
    first = f"({rest} - {parts - 1} * ({rest} div {parts}))"
    each = []
    for i in range(parts):
        turn = f"cast({first} + {i - 1} * ({rest} div {parts}) as int)" if i else "0"
        size = f"{rest} div {parts}" if i else first
        turned = f"shiftleft({low}, {turn}) | shiftrightunsigned({low}, cast({rest} - {turn} as int))" if i else low
        each.append(f"struct(path * {parts} + {i + 1} as path, cast(exact + {size} as int) as exact, (p - {low}) | (({turned}) & case when exact = 0 then -1L else shiftleft(1L, {rest}) - 1 end) as p)")
    return rows.select("fp", F.explode(F.expr(f"array({', '.join(each)})")).alias("r")).select("fp", "r.*").withColumn("key", F.expr("shiftrightunsigned(p, 64 - exact)"))


def _forest(part: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Spanning forest of a group's links, as edges to smaller ``fp``."""
    p = part["p"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(p)
    p, fp = p[order], part["fp"].to_numpy(np.int64)[order]
    by = np.argsort(fp)  # so that the smallest index is the smallest signed value
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    root = np.arange(len(p))
    for x, y in trie_join(p, None, budget, int(part["exact"].iloc[0])):
        root = join_labels(len(root), place[x], place[y], root)
    moved = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({"a": fp[by][moved], "b": fp[by][root[moved]]})


def links(unique: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Spanning forests (a, b), b < a, of the links between distinct ``fp``.

    Joined over all groups they connect exactly what pairs within the budget
    connect. ``unique`` should be a materialised table.
    """
    groups = max(LEAST_GROUPS, -(-unique.count() // (LEAF // 2)))
    rows, found = unique.select("fp", F.lit(0).alias("path"), F.lit(0).alias("exact"), F.col("fp").alias("p")), []
    while True:
        dealt = _dealt(rows, budget + 1)
        heavy, path = materialize(dealt.groupBy("path", "key").count().where(F.col("count") > LEAF).select("path", "key"), "heavy")
        some = heavy.limit(1).count() > 0
        light = dealt.join(heavy, ["path", "key"], "left_anti") if some else dealt
        group = F.pmod(F.xxhash64("path", "key"), F.lit(groups)).alias("group")
        found.append(light.groupBy("path", group).applyInPandas(lambda part: _forest(part, budget), "a long, b long"))
        if not some:
            release(unique.sparkSession, path)
            return reduce(DataFrame.unionByName, found)
        rows, _ = materialize(dealt.join(heavy, ["path", "key"], "left_semi").select("fp", "path", "exact", "p"), "heavy-rows")


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots, from edges (a, b).

    Alternates large and small stars until nothing changes; each round is a
    table in the shared folder, so a lost executor repeats one round at most.
    Only counts and a checksum come to the driver.
    """
    spark = edges.sparkSession
    now, path = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        seen = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(seen) == before or not seen[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, later = materialize(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        after.count()
        release(spark, path)
        now, path = after, later


def components(prints: DataFrame, doc_id: str = "doc_id", budget: int = BUDGET) -> DataFrame:
    """``prints`` (with ``fp``), the ``root`` of its component and component_id,
    the smallest id reachable.

    ``prints`` is read several times and should be a materialised table.
    """
    spark = prints.sparkSession
    unique, path = materialize(prints.groupBy("fp").agg(F.min(doc_id).alias("least_id"), F.count("*").alias("n")), "prints")
    linked, star_path = materialize(stars(links(unique.select("fp"), budget)), "stars")
    linked = linked.select(F.col("node").alias("fp"), "root")
    rooted = unique.join(linked, "fp", "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    owner, _ = materialize(rooted.join(least, "root").select("fp", "n", "root", "component_id"), "owners")
    release(spark, path, star_path)
    return _spread_join(prints, owner, ["fp"], ["root", "component_id"])


def _spread_join(prints: DataFrame, owner: DataFrame, on: list[str], more: list[str]) -> DataFrame:
    """``prints`` with its owner's columns; the commonest have many keys."""
    total = owner.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(owner.where(F.col("n") * HOT_SHARE > total).select(*on, F.lit(True).alias("hot")))  # fewer than HOT_SHARE rows
    at = F.when(F.col("hot"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")).otherwise(0)
    salted = prints.join(hot, on, "left").withColumn("salt", at).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    owners = owner.join(hot, on, "left").select(*on, *more, F.explode(copies).alias("salt"))
    return salted.join(owners, [*on, "salt"]).drop("salt")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    prints, _ = materialize(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "fp"), "prints")
    return components(prints).select("doc_id", "fp", "component_id")


#: Near copies: words in a shingle, least Jaccard similarity, and how often a
#: bit of two texts' fingerprints differs at that similarity (the angle of the
#: sets' vectors, 27.3 of 180 degrees).
NEAR_SHINGLE, SIMILARITY, BIT_APART = 5, 0.8, 0.1515
#: 64-bit words that a pair is judged by, and the differing bits (of 768; at
#: the least similarity 116 +- 10) up to which it is compared by its texts.
WIDE, NEAR_BITS = 12, 142
#: Least first bits of a slice that must agree, and differing bits of its 64.
LEAST_EXACT, SLICE_BUDGET = 12, 16
WIDE_BRUTE = 1 << 12
#: Share of pairs of the least similarity that meet in some slice, and rows of
#: one value of a slice's first bits that stay together.
MET, NEAR_LEAF = 0.97, 1 << 13
#: Candidates of a row that one more round names at most, times so many a round.
MORE = 8
WORDS = [f"w{k}" for k in range(WIDE)]


def plan_of(n: int) -> tuple[int, int, int]:
    """First bits that must agree, slices and 64-bit words for ``n`` rows.

    Groups must not grow with the rows, so the bits grow with their logarithm;
    as fewer pairs agree on more bits, slices are added so that the share that
    meets stays ``MET``, and words so that no two slices share first bits.
    """
    exact = max(LEAST_EXACT, int(2 * n // NEAR_LEAF).bit_length())
    slices = math.ceil(math.log(1 - MET) / math.log(1 - (1 - BIT_APART) ** exact))
    return exact, slices, max(WIDE, -(-slices * exact // 64))


def wide_of(text: str | None, words: int = WIDE) -> list[int]:
    """The wide fingerprint: as many of 64 bits, over the set of shingles."""
    h = np.unique(np.array(hashes(text, NEAR_SHINGLE), np.uint64))
    out = []
    for k in range(words):
        x = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(fingerprint_of(x ^ (x >> np.uint64(31))))
    return out


def _slices(rows: DataFrame, exact: int, slices: int) -> DataFrame:
    """Rows (id, w*) once a slice: ``p``, 64 bits from its start on, around the
    end of array ``wide``, and its first bits as ``key``."""
    each = []
    for path in range(slices):
        k, off = divmod(path * exact, 64)
        p = f"wide[{k}]" if not off else f"shiftleft(wide[{k}], {off}) | shiftrightunsigned(wide[({k} + 1) % size(wide)], {64 - off})"
        each.append(f"struct({path} as path, {p} as p)")
    own = [F.col("wide")[k].alias(w) for k, w in enumerate(WORDS)]
    return rows.select("id", *own, F.explode(F.expr(f"array({', '.join(each)})")).alias("r")).select("id", *WORDS, "r.*").withColumn("key", F.shiftrightunsigned("p", 64 - exact))


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the links that join components most closely (all ties
    resolved by place), and the roots after them: a least spanning forest."""
    rank = np.empty(len(d), np.int64)
    rank[np.argsort(d, kind="stable")] = np.arange(len(d))
    at, chosen = np.arange(len(d)), [np.zeros(0, np.int64)]
    while True:
        ra, rb = root[a[at]], root[b[at]]
        far = ra != rb
        at, ra, rb = at[far], ra[far], rb[far]
        if not len(at):
            return np.concatenate(chosen), root
        best = np.full(len(root), len(d))
        np.minimum.at(best, ra, rank[at])
        np.minimum.at(best, rb, rank[at])
        picked = at[(rank[at] == best[ra]) | (rank[at] == best[rb])]
        chosen.append(picked)
        root = join_labels(len(root), a[picked], b[picked], root)


def _nearest(x: np.ndarray, y: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Places of the pairs that are among the ``most`` nearest of either end."""
    keep = np.zeros(len(d), bool)
    for end in (x, y):
        order = np.lexsort((d, end))
        start = np.flatnonzero(np.concatenate(([True], end[order][1:] != end[order][:-1])))
        place = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d))))
        keep[order[place < most]] = True
    return np.flatnonzero(keep)


def _met_before(off: np.ndarray, path: int, exact: int) -> np.ndarray:
    """Whether pairs of differing bits ``off`` meet in a slice before ``path``.

    Such a pair is named there, so that each is named once, however many slices
    it meets in. Slices beyond the words at hand aren't looked at.
    """
    found = np.zeros(len(off), bool)
    for j in range(path):
        k, at = divmod(j * exact, 64)
        if k + 1 >= WIDE:
            break
        bits = off[:, k] << np.uint64(at) | (off[:, k + 1] >> np.uint64(64 - at) if at else np.uint64(0))
        found |= (bits >> np.uint64(64 - exact) == 0) & (np.bitwise_count(bits) <= SLICE_BUDGET)
    return found


def _candidates(part: pd.DataFrame, failed: pd.DataFrame | None, exact: int, most: int) -> pd.DataFrame:
    """Pairs of a group to compare by their texts next.

    Of those that the wide fingerprints call close and no link joins so far:
    in the first round a least spanning forest; later, without the pairs that
    ``failed`` there, up to ``most`` a row, its nearest. Rows of the right side
    meet those of the left only, where there are both.
    """
    path, group = part["path"].iloc[0], part["group"].iloc[0]
    order = np.lexsort((part["id"].to_numpy(), part["p"].to_numpy(np.int64).view(np.uint64)))
    p = part["p"].to_numpy(np.int64).view(np.uint64)[order]
    wide = part[WORDS].to_numpy(np.int64).view(np.uint64)[order]
    ids = part["id"].to_numpy()[order]
    left = part["left"].to_numpy(bool)[order]
    known, root = np.unique(part["root"].to_numpy()[order], return_inverse=True)
    n, lost = len(p), np.zeros(0, np.int64)
    if failed is not None and len(failed):  # by place among all the ids, each once
        names = np.unique(ids)
        lost = np.unique(np.searchsorted(names, failed["a"].to_numpy()) * n + np.searchsorted(names, failed["b"].to_numpy()))
        name = np.searchsorted(names, ids)
    one, two = np.flatnonzero(left), np.flatnonzero(~left)
    labels, found, pending = np.arange(len(known)), [], []
    for x, y in trie_join(p, None, SLICE_BUDGET, exact, brute=WIDE_BRUTE) if not len(two) else trie_join(p[one], p[two], SLICE_BUDGET, exact, brute=WIDE_BRUTE):
        if len(two):
            x, y = one[x], two[y]
        apart = labels[root[x]] != labels[root[y]]
        x, y = x[apart], y[apart]
        off = wide[x] ^ wide[y]
        d = np.bitwise_count(off).sum(axis=1, dtype=np.int64)
        near = d <= NEAR_BITS
        near[near] = ~_met_before(off[near], int(path), exact)
        if len(lost):
            a, b = np.maximum(name[x], name[y]), np.minimum(name[x], name[y])
            near &= ~np.isin(a * n + b, lost)
        x, y, d = x[near], y[near], d[near]
        if not most:
            picked, labels = spanning(root[x], root[y], d, labels)
            found.append(np.stack([ids[x[picked]], ids[y[picked]]], axis=1))
        elif len(x):
            pending.append((x, y, d))
            if sum(len(q[0]) for q in pending) > FRONTIER * 16:
                x, y, d = (np.concatenate(c) for c in zip(*pending, strict=True))
                at = _nearest(x, y, d, most)
                pending = [(x[at], y[at], d[at])]
    if pending:
        x, y, d = (np.concatenate(c) for c in zip(*pending, strict=True))
        at = _nearest(x, y, d, most)
        found.append(np.stack([ids[x[at]], ids[y[at]]], axis=1))
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pd.DataFrame({"path": path, "group": group, "a": pairs.max(axis=1), "b": pairs.min(axis=1)})


def _later(exact: int, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """:func:`_candidates` of a round after the first."""
    return lambda part, lost: _candidates(part, lost, exact, most)


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of two texts' sets of shingles; of none and none 1."""
    x, y = set(hashes(a, NEAR_SHINGLE)), set(hashes(b, NEAR_SHINGLE))
    return len(x & y) / len(x | y) if x or y else 1.0


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) and whether their texts' similarity links them, ``ok``."""

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) >= SIMILARITY for x, y in zip(a, b, strict=True)], dtype=bool)

    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", alike("ta", "tb").alias("ok"))


def _rounds(dealt: DataFrame, texts: DataFrame, exact: int, linked: DataFrame) -> DataFrame:
    """Links (node, root) once no group of ``dealt`` (path, group, left, id,
    w*, p) holds a close pair that is neither joined nor compared.

    A round names pairs, compares their texts and joins those alike. Only
    groups where a named pair has failed go on: without one, the forest of the
    first round has joined all that the group's close pairs join.
    """
    spark = dealt.sparkSession
    schema, most, tested, failed, again = "path int, group long, a long, b long", 0, None, None, dealt
    while True:
        rows = again.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        by = rows.groupBy("path", "group")
        if failed is None:
            named = by.applyInPandas(lambda part: _candidates(part, None, exact, 0), schema)
        else:
            named = by.cogroup(failed.groupBy("path", "group")).applyInPandas(_later(exact, most), schema)
        named, _ = materialize(named, "named")
        fresh = named.select("a", "b").distinct()
        fresh = fresh if tested is None else fresh.join(tested, ["a", "b"], "left_anti")
        now, _ = materialize(_compared(fresh, texts), "tested")
        tested = now if tested is None else tested.unionByName(now)
        linked, _ = materialize(stars(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(now.where("ok").select("a", "b"))), "stars")
        lost, _ = materialize(named.join(tested.where("not ok").select("a", "b"), ["a", "b"]), "lost")
        if not lost.limit(1).count():
            return linked
        failed = lost if failed is None else failed.unionByName(lost)
        active = lost.select("path", "group").distinct()
        failed = failed.join(active, ["path", "group"], "left_semi")
        again = dealt.join(active, ["path", "group"], "left_semi")
        most = max(1, most) * MORE


def near_links(unique: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(node, root) of distinct wide fingerprints (id, array ``wide``) that
    links of alike texts join, but for the roots.

    Close pairs meet in groups of equal first bits. A value that more than
    ``NEAR_LEAF`` share is dealt in chunks first. What their links leave apart
    from the value's largest component then meets the whole value, chunk by
    chunk: within that component nothing is left to join.
    """
    exact, slices, _ = plan_of(n)
    groups = max(LEAST_GROUPS, -(-n // NEAR_LEAF))
    cut = _slices(unique, exact, slices)
    heavy, _ = materialize(cut.groupBy("path", "key").count().where(F.col("count") > NEAR_LEAF).select("path", "key", F.ceil(F.col("count") / NEAR_LEAF).cast("int").alias("chunks")), "heavy")
    chunked = cut.join(heavy, ["path", "key"], "left").withColumn("chunk", F.pmod(F.xxhash64("id", "path"), F.coalesce("chunks", F.lit(1))).cast("int"))
    dealt = chunked.select("path", F.pmod(F.xxhash64("path", "key", "chunk"), F.lit(groups)).alias("group"), F.lit(True).alias("left"), "id", *WORDS, "p")
    linked = _rounds(dealt, texts, exact, unique.sparkSession.createDataFrame([], "node long, root long"))
    if not heavy.limit(1).count():
        return linked
    hot, _ = materialize(cut.join(heavy, ["path", "key"]).withColumn("chunk", F.pmod(F.xxhash64("id", "path"), F.col("chunks")).cast("int")).join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")), "hot")
    largest = hot.groupBy("path", "key", "root").count().groupBy("path", "key").agg(F.max_by("root", F.struct("count", "root")).alias("most"))
    rest, _ = materialize(hot.join(largest, ["path", "key"]).where("root <> most").drop("most"), "rest")
    if not rest.limit(1).count():
        return linked
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    ours = rest.withColumn("with", every).withColumns({"i": F.col("chunk"), "j": F.col("with"), "left": F.lit(True)})
    theirs = hot.withColumn("with", every).withColumns({"i": F.col("with"), "j": F.col("chunk"), "left": F.lit(False)}).join(rest.select("path", "key", F.col("chunk").alias("i")).distinct(), ["path", "key", "i"], "left_semi")
    tiles = ours.unionByName(theirs).select("path", F.xxhash64("path", "key", "i", "j").alias("group"), "left", "id", *WORDS, "p")
    return _rounds(tiles, texts, exact, linked)


def near_copies(rows: DataFrame, n: int) -> DataFrame:
    """``row`` and ``root``, the smallest row of its group, of every row.

    ``rows`` (row, text, wide) should be a materialised table of ``n`` rows,
    with the words that :func:`plan_of` asks for. Texts link where their
    similarity is 0.8 or more; equal fingerprints are one.
    """
    spark = rows.sparkSession
    prints = rows.select("row", "wide")
    unique, path = materialize(prints.groupBy("wide").agg(F.min("row").alias("id"), F.count("*").alias("n")), "wide")
    texts, text_path = materialize(rows.select("row", "text").join(unique.select(F.col("id").alias("row")), "row", "left_semi"), "ends")
    linked = near_links(unique.select("id", "wide"), texts, n)
    owner, _ = materialize(unique.join(linked.withColumnRenamed("node", "id"), "id", "left").select("wide", "n", F.coalesce("root", "id").alias("root")), "owners")
    release(spark, path, text_path)
    return _spread_join(prints, owner, ["wide"], ["root"]).select("row", "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: its smallest id.

    Near copies by :func:`near_copies`: five-word shingles, a Jaccard
    similarity of 0.8 or more. Among rows of one id the one
    written first stays; a row without an id stays only where none of its
    group has one. All columns are kept, whatever their names.
    """
    n = docs.count()
    words = plan_of(n)[2]

    @F.pandas_udf("array<long>")
    def wide(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(wide_of(t, words), np.uint64).view(np.int64) for t in texts])

    columns = docs.columns
    own_id, own_text = (f"c{columns.index(c)}__" for c in (doc_id, text))
    named = docs.select(*[F.col(f"`{c}`").alias(f"c{k}__") for k, c in enumerate(columns)], wide(F.col(text)).alias("wide__"))
    rows, _ = materialize(named.withColumn("row__", F.monotonically_increasing_id()), "dedup")
    found = near_copies(rows.select(F.col("row__").alias("row"), F.col(own_text).alias("text"), F.col("wide__").alias("wide")), n)
    with_id = found.withColumnRenamed("row", "row__").join(rows.select("row__", F.col(own_id).alias("id__")), "row__")
    best = with_id.groupBy("root").agg(F.expr("min_by(row__, struct(id__ is null, id__, row__))").alias("row__"))
    return rows.join(best.select("row__"), "row__", "left_semi").select(*[F.col(f"c{k}__").alias(c) for k, c in enumerate(columns)])
