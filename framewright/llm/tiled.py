"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors become unit vectors in double precision, turned by the eigenvectors of
their second moments, the widest first. For such vectors a pair's product is at
most the product of their leading parts plus the product of their suffixes'
norms (Cauchy-Schwarz). So a tile of vectors meets another in the leading
dimensions first, with the norms of what is left as one column more; pairs
that can't reach the threshold any more stop there, the others add the next
dimensions, and the few that pass all are judged by the cosine of the vectors
as they were given. The turn is orthogonal, so it only decides how early a pair
stops, never whether it links.

Tiles come from a tree of cuts through the leading dimensions and the suffix
norm, so that they are compact, and pairs of tiles whose boxes are too far
apart are never dealt. A tile with more than ``MOST`` vectors is dealt in
parts. A task holds two parts, and sends back counts and a spanning forest of
its links, never the links. On vectors without any structure (all directions
alike) boxes overlap and the comparison is quadratic in their number, as for
any exact method; memory stays bounded then too.

Equal vectors are one class from the start, with a digest as its name, so a
large group of copies is one row. Only the sums of second moments (dimensions
squared), the cuts' sample (at most ``SAMPLE`` vectors, for balance only: every
vector is compared) and boxes of at most ``TILES`` tiles a length reach the driver.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths; repeated
rows and equal ids are rows of their own; ids null never are a component's
smallest unless all are; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import join_labels, materialize
from framewright.llm.simhash import _spread_join, stars

LEAST_COSINE = 0.95
#: What rounding may take from a bound, far above double precision's errors.
SLACK = 1e-9
#: Leading dimensions that order and cut tiles, and those added at a time after.
LEAD, NEXT = 16, 16
#: Vectors of a part, sides of a compared square, tiles and sampled vectors.
MOST, SQUARE = 8192, 1024
TILES, SAMPLE = 4096, 16384
#: Of a square's pairs, one in so many may stay for a comparison one by one.
FEW = 16


def _doubles(vector: Column) -> Column:
    """A vector's components as little-endian doubles; null if it links with
    nothing."""

    @F.pandas_udf("binary")
    def packed(parts: pd.Series) -> pd.Series:
        def one(v) -> bytes | None:
            if v is None or not len(v):
                return None
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v.dtype == object else v.astype("<f8")
            top = np.abs(x).max()
            return (x + 0.0).tobytes() if np.isfinite(x).all() and top > 0 else None

        return parts.map(one)

    return packed(vector)


def _units(vectors: list[bytes]) -> np.ndarray:
    """Unit vectors, without overflow or underflow of squares."""
    x = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bases(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each length the eigenvectors of all its unit vectors' second
    moments, as columns, the widest first."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for size, same in part.groupby("size"):
                x = _units(same["vector"].tolist())
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, s in sums.items():
            i, j = np.triu_indices(size)
            yield pd.DataFrame({"size": size, "i": i, "j": j, "s": s[i, j]})

    found: dict[int, np.ndarray] = {}
    each = classes.select("size", "vector").mapInPandas(partial, "size int, i int, j int, s double")
    for size, own in each.groupBy("size", "i", "j").agg(F.sum("s").alias("s")).toPandas().groupby("size"):
        m = np.zeros((size, size))
        m[own["i"], own["j"]] = m[own["j"], own["i"]] = own["s"]
        found[int(size)] = np.linalg.eigh(m)[1][:, ::-1].copy()
    return found


def leading(vectors: list[bytes], basis: np.ndarray) -> np.ndarray:
    """Turned leading components, and the norm of the others."""
    turned = _units(vectors) @ basis
    k = min(LEAD, turned.shape[1])
    return np.concatenate([turned[:, :k], np.sqrt((turned[:, k:] ** 2).sum(axis=1))[:, None]], axis=1)


def cuts(sample: np.ndarray, n_tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree's dimension and value at each node, in heap order: at every node
    the widest dimension is cut at the sample's middle."""
    dims, values = np.zeros(n_tiles, np.int64), np.zeros(n_tiles)
    held = {1: sample}
    for node in range(1, n_tiles):
        own = held.pop(node, sample[:0])
        if len(own):
            dims[node] = int(np.argmax(own.std(axis=0)))
            values[node] = np.median(own[:, dims[node]])
        low = own[:, dims[node]] < values[node]
        held[2 * node], held[2 * node + 1] = own[low], own[~low]
    return dims, values


def tile_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The tile (0 on) of points, by the tree's cuts."""
    dims, values = tree
    at = np.ones(len(points), np.int64)
    for _ in range(len(dims).bit_length() - 1):
        at = 2 * at + (points[np.arange(len(points)), dims[at]] >= values[at])
    return at - len(dims)


def _placed(classes: DataFrame, basis: dict[int, np.ndarray], trees: dict[int, tuple]) -> DataFrame:
    """Classes with their tile, and their part of it by a hash, later on."""

    @F.pandas_udf("tile int, point array<double>")
    def place(sizes: pd.Series, vectors: pd.Series) -> pd.DataFrame:
        tile, point = np.zeros(len(sizes), np.int32), [None] * len(sizes)
        for size in sizes.unique():
            at = np.flatnonzero(sizes.to_numpy() == size)
            p = leading(vectors.iloc[at].tolist(), basis[int(size)])
            tile[at] = tile_of(p, trees[int(size)])
            for i, row in zip(at, p, strict=True):
                point[i] = row
        return pd.DataFrame({"tile": tile, "point": pd.Series(point, dtype=object)})

    return classes.withColumn("p", place("size", "vector")).select("cls", "digest", "m", "size", "vector", "p.*")


def _boxes(placed: DataFrame) -> DataFrame:
    """Count and box of each tile: a row a tile, in all a bounded number."""

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, list] = {}
        for part in parts:
            for key, own in part.groupby(["size", "tile"]):
                p = np.stack(own["point"].tolist())
                n, low, high = seen.get(key, (0, np.inf, -np.inf))
                seen[key] = [n + len(p), np.minimum(low, p.min(axis=0)), np.maximum(high, p.max(axis=0))]
        for (size, tile), (n, low, high) in seen.items():
            yield pd.DataFrame({"size": size, "tile": tile, "dim": np.arange(len(low)), "n": n, "low": low, "high": high})

    each = placed.select("size", "tile", "point").mapInPandas(partial, "size int, tile int, dim int, n long, low double, high double")
    return each.groupBy("size", "tile", "dim").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def partners(boxes: pd.DataFrame, least: float) -> list[tuple[int, int, list[int], list[int]]]:
    """Of each tile: its length, number and parts, and the tiles whose boxes are
    near enough, itself included, with their parts."""
    reach, out = 2 - 2 * least + SLACK, []
    for size, own in boxes.groupby("size"):
        wide = own.pivot(index="tile", columns="dim", values=["low", "high"]).sort_index()
        low, high = wide["low"].to_numpy(), wide["high"].to_numpy()
        tiles = wide.index.to_numpy()
        n = own[own["dim"] == 0].set_index("tile")["n"].reindex(tiles).to_numpy()
        parts = -(-n // MOST)
        for k, t in enumerate(tiles):
            gap = np.maximum(0, np.maximum(low - high[k], low[k] - high))
            near = np.flatnonzero((gap * gap).sum(axis=1) <= reach)
            out.append((int(size), int(t), int(parts[k]), tiles[near].tolist(), parts[near].tolist()))
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, least: float, itself: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs of turned unit vectors whose product may reach
    ``least``, square by square; of a set with itself i < j."""
    d, stops = x.shape[1], []
    for k in [*range(LEAD, x.shape[1], NEXT), x.shape[1]]:
        stops.append((stops[-1][1] if stops else 0, min(k, d)))
    rest = lambda v: [np.sqrt((v[:, b:] ** 2).sum(axis=1)) for _, b in stops]
    x_rest, y_rest = rest(x), rest(y)
    for r in range(0, len(x), SQUARE):
        a = slice(r, r + SQUARE)
        for c in range(r if itself else 0, len(y), SQUARE):
            b, i, product = slice(c, c + SQUARE), None, None
            for k, (first, last) in enumerate(stops):
                if i is None:  # all pairs of the square, the norms as a column more
                    more = x[a, first:last] @ y[b, first:last].T
                    product = more if product is None else product + more
                    may = product + np.outer(x_rest[k][a], y_rest[k][b]) >= least - SLACK
                    if np.count_nonzero(may) * FEW <= may.size or k == len(stops) - 1:
                        i, j = np.nonzero(may)
                        product = product[i, j]
                else:  # those that are left, one by one
                    product = product + np.einsum("ij,ij->i", x[a][i, first:last], y[b][j, first:last])
                    may = product + x_rest[k][a][i] * y_rest[k][b][j] >= least - SLACK
                    i, j, product = i[may], j[may], product[may]
                if i is not None and not len(i):
                    break
            i, j = i + r, j + c
            if itself:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise cosines of vectors as they were given, in double precision."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        scale = np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)
        found = np.einsum("ij,ij->i", x, y) / np.sqrt(scale)
    odd = ~((scale > 1e-200) & (scale < 1e200))
    if odd.any():  # squares near the ends of the range of doubles: scale first
        a, b = (v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True) for v in (x, y))
        found[odd] = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
    return found


def compared(part: pd.DataFrame, basis: dict[int, np.ndarray], least: float) -> pd.DataFrame:
    """Links of two parts of tiles, or of one with itself: for each class the
    vectors it links to (n), and a spanning forest (a, b) of all links."""
    left = part["left"].to_numpy(bool)
    itself = bool(part["itself"].iloc[0])
    ids, weight = part["cls"].to_numpy(np.int64), part["m"].to_numpy(np.int64)
    given = np.frombuffer(b"".join(part["vector"]), np.float64).reshape(len(part), -1)
    turned = _units(part["vector"].tolist()) @ basis[given.shape[1]]
    x = np.flatnonzero(left)
    y = x if itself else np.flatnonzero(~left)
    linked, by = np.zeros(len(part), np.int64), np.argsort(ids, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    root = np.arange(len(part))
    for i, j in close_pairs(turned[x], turned[y], least, itself):
        i, j = x[i], y[j]
        for at in range(0, len(i), 1 << 16):  # vectors of so many pairs at once
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = cosines(given[a], given[b]) >= least
            a, b = a[near], b[near]
            np.add.at(linked, a, weight[b])
            np.add.at(linked, b, weight[a])
            root = join_labels(len(root), place[a], place[b], root)
    some, moved = np.flatnonzero(linked), np.flatnonzero(root != np.arange(len(root)))
    counts = pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "n": linked[some]})
    edges = pd.DataFrame({"a": ids[by][moved], "b": pd.array(ids[by][root[moved]], "Int64"), "n": 0})
    return pd.concat([counts, edges])


def links(classes: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """(a, null, n) the linked vectors of class ``a`` that one pair of parts
    holds, and (a, b, 0) a forest of links between classes.

    ``classes`` (cls, digest, m, size, vector) should be a materialised table.
    """
    spark = classes.sparkSession
    basis = bases(classes)
    trees, sizes = {}, {r["size"]: r["count"] for r in classes.groupBy("size").count().collect()}  # a row a length
    for size, n in sizes.items():
        n_tiles = 1 << min(TILES.bit_length() - 1, max(0, -(-n // (MOST // 2)) - 1).bit_length())
        share = F.pmod(F.xxhash64("digest"), F.lit(max(1, n // (SAMPLE // 2)))) == 0
        sample = [bytes(r.vector) for r in classes.where((F.col("size") == size) & share).select("vector").limit(SAMPLE).collect()]
        trees[size] = cuts(leading(sample, basis[size]) if sample else np.zeros((0, min(LEAD, size) + 1)), n_tiles)
    placed, _ = materialize(_placed(classes, basis, trees), "tiles")
    boxes = _boxes(placed).toPandas()
    dealt_to = spark.createDataFrame(partners(boxes, least), "size int, tile int, parts int, near array<int>, near_parts array<int>")
    rows = placed.drop("point").join(F.broadcast(dealt_to), ["size", "tile"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    # each part meets every part of each near tile: the smaller (tile, part) is the left one
    meets = F.flatten(F.transform(F.arrays_zip("near", "near_parts"), lambda t: F.transform(F.sequence(F.lit(0), t["near_parts"] - 1), lambda p: F.struct(t["near"].alias("tile"), p.alias("part")))))
    own = F.struct("tile", "part")
    each = rows.select("cls", "m", "size", "vector", own.alias("own"), F.explode(meets).alias("other"))
    pair = each.select("cls", "m", "vector", "size", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("left"), (F.col("own") == F.col("other")).alias("itself"))
    return pair.groupBy("size", "x", "y").applyInPandas(lambda part: compared(part, basis, least), "a long, b long, n long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Links join vectors whose cosine is ``least`` or more; n_links counts the
    other vectors that a vector links to directly, component_id is the smallest
    id reachable over links, and the row of that id is kept.
    """
    named, _ = materialize(rows.select(F.col(f"`{vec_id}`").alias("vec_id"), _doubles(F.col(f"`{embedding}`")).alias("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    able = named.where("vector is not null").withColumn("digest", F.unhex(F.sha2("vector", 256)))
    each = able.groupBy("digest").agg(F.min("row").alias("cls"), F.min("vec_id").alias("least_id"), F.count("*").alias("m"), F.first("vector").alias("vector"))
    classes, _ = materialize(each.withColumn("size", (F.octet_length("vector") / 8).cast("int")), "classes")
    found, _ = materialize(links(classes, least), "links")
    linked = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n_links"))
    roots, _ = materialize(stars(found.where("b is not null").select("a", "b")), "stars")
    rooted = classes.drop("vector", "size").join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(linked, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    owner, _ = materialize(rooted.join(smallest, "root").select("digest", F.col("m").alias("n"), (F.coalesce("n_links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "owners")
    joined = _spread_join(able.select("vec_id", "digest"), owner, ["digest"], ["n_links", "component_id"]).select("vec_id", "n_links", "component_id")
    alone = named.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
