import duckdb
import numpy as np
import pytest

from framewright.llm import tiled
from framewright.llm.queries import ORACLES, op13_tiled
from framewright.llm.shared import join_labels

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, row int, n_links string"


def brute(rows):
    """All pairs, one product of the given vectors after another."""
    able = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    n, a, b = len(rows), [], []
    for i in able:
        for j in able:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    a.append(i)
                    b.append(j)
    linked = np.bincount(np.array(a + b, int), minlength=n)
    root = join_labels(n, np.array(a, int), np.array(b, int))
    least = {}
    for i, (v, _) in enumerate(rows):
        r = int(root[i])
        least[r] = v if least.get(r) is None else min(least[r], v if v is not None else least[r])
    return sorted(((v, int(linked[i]), least[int(root[i])], v == least[int(root[i])]) for i, (v, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, "y") for i, v in rows], SCHEMA)


def made(rng, n, d):
    """Loose vectors, chains of near ones, a third of them round one centre."""
    centre = rng.normal(size=d)
    rows = [rng.normal(size=d) for _ in range(n // 3)] + [centre + 0.16 * rng.normal(size=d) * np.linalg.norm(centre) / np.sqrt(d) for _ in range(n // 3)]
    while len(rows) < n:
        at = rows[rng.integers(len(rows))]
        rows.append(at + rng.choice([0.05, 0.2, 0.33, 0.4]) * rng.normal(size=d) * np.linalg.norm(at) / np.sqrt(d))
    rows += [rows[0]] * 5 + [2 * rows[0]]
    return [(int(k), np.array(v, np.float32).tolist()) for k, v in enumerate(rows)]


ODD = [
    (5001, None), (5002, []), (5003, [0.0] * 8), (5004, [1.0, None] + [0.0] * 6), (5005, [float("nan")] + [1.0] * 7), (5006, [float("inf")] + [1.0] * 7),
    (5007, [1.0, 0.0]), (5008, [1.0, 0.1]), (5009, [1.0, -0.0]), (5007, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (5010, [3e38] * 8), (5011, [1e-40] * 8), (5012, [-1.0] * 8),
]


@pytest.mark.parametrize(("d", "most", "lead", "square"), [(64, 8192, 16, 1024), (8, 16, 3, 5), (40, 20, 16, 8)])
def test_brute_force(spark, monkeypatch, d, most, lead, square):
    for name, value in (("MOST", most), ("LEAD", lead), ("NEXT", lead), ("SQUARE", square)):
        monkeypatch.setattr(tiled, name, value)
    rows = made(np.random.default_rng(d), 150, d) + ODD
    want = brute(rows)
    assert got(tiled.near_duplicates(frame(spark, rows))) == want
    assert max(r[1] for r in want) > 20


def test_a_hot_tile_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tiled, "MOST", 16)
    monkeypatch.setattr(tiled, "TILES", 2)
    rows = made(np.random.default_rng(1), 120, 12)
    assert got(tiled.near_duplicates(frame(spark, rows))) == brute(rows)


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for d in (3, 16, 17, 50):
        x = rng.normal(size=(300, d))
        x[150:] = x[:150] + 0.3 * rng.normal(size=(150, d))
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= 0.95
        found = {(int(a), int(b)) for i, j in tiled.close_pairs(x, x, 0.95, True) for a, b in zip(i, j, strict=True)}
        assert {(i, j) for i, j in zip(*np.nonzero(near), strict=True) if i < j} <= found
        assert len(found) < 1.01 * max(300, near.sum())


def test_empty(spark):
    assert tiled.near_duplicates(frame(spark, []).where("true")).count() == 0
    assert got(tiled.near_duplicates(frame(spark, ODD[:6]))) == [(i, 0, i, True) for i in range(5001, 5007)]


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view embeddings as select * from '{d}/embeddings.parquet'")
    want = sorted(duckdb.sql(ORACLES["op13_tiled"]).select("vec_id, n_links, component_id, kept").fetchall(), key=repr)
    assert got(op13_tiled(spark, d)) == want
    rows = made(np.random.default_rng(4), 80, 10) + ODD
    duckdb.sql("create or replace table embeddings_made (vec_id bigint, embedding float[])")
    duckdb.sql("create or replace view embeddings as select * from embeddings_made")
    duckdb.connect(":default:").executemany("insert into embeddings_made values (?, ?)", [list(r) for r in rows])
    assert sorted(duckdb.sql(ORACLES["op13_tiled"]).select("vec_id, n_links, component_id, kept").fetchall(), key=repr) == brute(rows)
