import hashlib
import random
import re
import zlib

import duckdb
import pytest

from framewright.llm import prefix_trie
from framewright.llm.queries import ORACLES, op12_prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rebuilt(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    convs = {c: [v[3:] for v in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        start = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = tuple(convs.get(start, [])[:h] + own[h:])
    return out


def brute(convs):
    """Every prefix of every sequence in a dictionary, walked from below."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    totals = {p: [0, 0, 0] for p in members}
    for p in sorted(members, key=len, reverse=True):
        t = totals[p]
        t[1] = t[1] or 1
        t[2] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        if p:
            up = totals[p[:-1]]
            up[0] += 1
            up[1] += t[1]
            up[2] += t[2]
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if convs[c] == p)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, b"x", "y", 3) for r in rows], "conv_id long, turn int, role string, text string, ids binary, conv string, words int")


def logs(rng, n=60, most=9):
    """Conversations that share beginnings, copies, one long, ties and nulls."""
    rows, said = [], []
    for c in range(n):
        turns = list(rng.choice(said))[: rng.randint(0, most)] if said and rng.random() < 0.7 else []
        turns += [(rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b c", "", None, "d\te f\n"])) for _ in range(rng.randint(0, 3))]
        turns = turns or [(None, None)]
        said.append(turns)
        rows += [(c, t, *x) for t, x in enumerate(turns)]
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(n // 2) for t in range(4)]
    rows += [(2003, t, "user", str(t // 2)) for t in range(40)] + [(2005, t, "user", str(t // 2)) for t in range(37)]
    rows += [(None, 1, "user", "no id"), (-7, 1, "user", "a"), (-20, 1, "user", "z"), (3000, None, "user", "first"), (3000, 2, "user", "tie"), (3000, 2, "assistant", "tie"), (3001, 1, "user", "a"), (3001, 1, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limit", "stride"), [(1 << 16, 1024), (12, 1024), (3, 4), (1 << 16, 1)])
def test_random_logs(spark, monkeypatch, limit, stride):
    monkeypatch.setattr(prefix_trie, "LIMIT", limit)
    monkeypatch.setattr(prefix_trie, "STRIDE", stride)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    most = 9 if stride > 1 else 3
    rows = [r for r in logs(random.Random(limit + stride), 40, most) if stride > 1 or r[0] is None or r[1] is None or r[1] < 5]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rebuilt(rows))


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(frame(spark, [(None, 1, "user", "x")])).count() == 0
    alone = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:3]
    rows = [(c, 0, "user", "x") for c in alone]
    assert got(prefix_trie.prefix_trie(frame(spark, rows))) == brute(rebuilt(rows)) and len(brute(rebuilt(rows))) == 1


def test_sql(spark):
    d = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view conversations as select * from '{d}/conversations.parquet'")
    want = sorted(duckdb.sql(ORACLES["op12_prefix_trie"]).select(", ".join(COLUMNS)).fetchall(), key=repr)
    assert got(op12_prefix_trie(spark, d)) == want
