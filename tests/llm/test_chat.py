import random

import duckdb

from framewright.llm import chat
from framewright.llm.queries import ORACLES, op7_chat


def brute(rows):
    convs = {}
    for c, t, r, x in {(c, t, r or "unknown", x or "") for c, t, r, x in rows}:
        convs.setdefault(c, []).append((t is not None, t or 0, r, chat_digest(x), x))
    lists = {c: tuple((r, x) for _, _, r, _, x in sorted(v)) for c, v in convs.items()}
    prefix = {v[:k] for v in lists.values() for k in range(1, len(v))}
    out = {}
    for v in set(lists.values()) - prefix:
        same = [c for c, w in lists.items() if w == v]
        text = "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v)
        out[min((c for c in same if c is not None), default=None)] = (len(v), len(same), text)
    return out


def chat_digest(x):
    import hashlib

    return hashlib.sha256(x.encode()).hexdigest()


def frame(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn int, role string, text string, n string, h1 int")


def test_random_logs(spark):
    rng = random.Random(7)
    for _ in range(4):
        rows, conv = [], 0
        for _ in range(30):
            said = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None])) for _ in range(rng.randint(1, 6))]
            for n in {rng.randint(1, len(said)) for _ in range(3)}:
                rows += [(conv, t, *said[t]) for t in range(n)]
                conv += 1
        rows += rows[:5] + [(None, 1, "user", "x"), (None, None, "user", "first"), (1000, 3, None, None), (1001, 0, "user", "long " * 50_000), (1001, 0, "tie", "y")]
        got = {r.conv_id: (r.n_turns, r.copies, r.text) for r in chat.rendered(frame(spark, rows)).collect()}
        assert got == brute(rows)


def test_empty(spark):
    assert chat.rendered(frame(spark, []).where("true")).count() == 0


def test_sql(spark):
    d = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view conversations as select * from '{d}/conversations.parquet'")
    want = sorted(duckdb.sql(ORACLES["op7_chat"]).fetchall())
    got = sorted(tuple(r) for r in op7_chat(spark, d).select("conv_id", "n_turns", "copies", "text").collect())
    assert got == want


def test_no_python_in_the_plan(spark):
    plan = op7_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
