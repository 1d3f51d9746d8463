import uuid

import pytest
from pyspark.sql import functions as F

from framewright.llm import sharding
from framewright.llm.queries import op10_sharding
from framewright.llm.shared import shared_dir


def store(spark, **kw):
    return sharding.ShardStore(spark, f"{shared_dir(spark)}/test-shards-{uuid.uuid4().hex}", **kw)


def rows(df):
    return sorted(map(str, df.collect()))


def test_appends_and_compaction_keep_every_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = store(spark, target=200_000)
    halves = [docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 <> 0")]
    for h in halves:
        s.append(h, shard_rows=20)
    before = s.manifest()
    assert s.version() == 2 and before.count() >= 50
    old = rows(s.read(docs.schema, 2))
    s.compact(docs.schema)
    after = s.manifest().collect()
    assert len(after) < 0.4 * before.count() and sum(r.n_rows for r in after) == docs.count()
    assert max(r.level for r in after) >= 1 and sum(r.n_bytes < 100_000 for r in after) <= 2
    assert rows(s.read(docs.schema)) == rows(docs) == old
    assert rows(s.read(docs.schema, 2)) == old  # readers of the old version are not disturbed
    s.expire()
    assert rows(s.read(docs.schema)) == old
    version = s.version()
    assert s.compact(docs.schema) == version  # nothing is left to merge


def test_second_writer_of_a_version_fails(spark):
    s = store(spark)
    s.append(spark.range(3).toDF("doc_id"))
    with pytest.raises(sharding.CommitConflict):
        s._commit(s.manifest(), 1)
    assert s.version() == 1


def test_a_writer_that_dies_leaves_readers_alone(spark):
    """What is left before the rename is no version, and later commits work."""
    s = store(spark)
    docs = spark.range(5).toDF("doc_id")
    s.append(docs)
    fs, where = s._path("manifests/_dead")
    fs.mkdirs(where)
    fs.create(s._path("manifests/_dead/_owner-dead")[1], False).close()
    docs.write.parquet(f"{s.root}/data/arrival-2-dead")
    assert s.version() == 1 and rows(s.read(docs.schema)) == rows(docs)
    s.append(docs)
    assert s.version() == 2 and s.read(docs.schema).count() == 10
    s.expire()
    assert s.versions() == [2] and s.read(docs.schema).count() == 10
    s.expire()


def test_writers_at_once_commit_one_after_another(spark):
    from concurrent.futures import ThreadPoolExecutor

    s = store(spark)
    one = spark.range(3).toDF("doc_id")

    def append(k):
        try:
            return s.append(one.withColumn("k", F.lit(k)))
        except sharding.CommitConflict:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [v for v in pool.map(append, range(4)) if v]
    assert sorted(won) == s.versions() and s.read(one.withColumn("k", F.lit(0)).schema).count() == 3 * len(won)


def test_tiers_merge_over_arrivals(spark):
    """Runs never mix sizes further apart than a tier; tiers rise with merges."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    s, seen = store(spark, target=60_000), set()
    for k in range(8):
        s.append(docs.where(F.pmod("doc_id", F.lit(8)) == k), shard_rows=16)
        for r in s.plan().collect():
            sizes = [x.n_bytes for x in s.manifest().collect() if x.shard in r["shards"]]
            assert len(sizes) >= 4 and max(sizes) <= 4 * min(sizes) and sum(sizes) <= 60_000 + max(sizes)
        s.compact(docs.schema)
        seen |= {x.level for x in s.manifest().collect()}
        s.expire()
    assert rows(s.read(docs.schema)) == rows(docs) and {0, 1} & seen and max(seen) >= 1
    assert s.plan().count() == 0


def test_odd_rows(spark, odd, none):
    s = store(spark)
    odd = odd.withColumnRenamed("kept", "shard").withColumnRenamed("fp", "_metadata")
    s.append(odd, shard_rows=2)
    s.append(odd.where("false"))
    s.compact()
    assert sum(r.n_rows for r in s.manifest().collect()) == odd.count()
    kept = odd.withColumn("a.b", F.col("`a.b`").cast("string"))
    assert rows(s.read(kept.schema)) == rows(kept)
    with pytest.raises(ValueError):
        s.read(kept.schema, shard_as="Shard")
    assert s.read(kept.schema, shard_as="lies_in").select("lies_in").distinct().count() >= 1
    empty = store(spark)
    assert empty.manifest().count() == 0 and empty.compact() == 0
    empty.append(none)
    assert empty.read(none.schema).count() == 0


def test_query(spark):
    got = op10_sharding(spark, "/root/testdata/sf0.01")
    assert got.count() == got.select("doc_id").distinct().count() == 1000
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_plan_against_a_plain_one(spark, monkeypatch):
    """Runs follow one another in time, however many shards an arrival has."""
    import math
    import random

    rng = random.Random(8)
    shards = [(f"s{k:04d}", 0, rng.randrange(1, 12), 10, rng.choice((100, 400, 1600)) + rng.randrange(60)) for k in range(300)]
    s = store(spark, target=5000)
    monkeypatch.setattr(s, "manifest", lambda version=None: spark.createDataFrame(shards, sharding.MANIFEST))
    arrived = {x[0]: x[2] for x in shards}
    size = {x[0]: x[4] for x in shards}
    want = {}
    for name, _, _, _, n in sorted(shards, key=lambda x: (x[2], x[0])):
        tier = math.floor(math.log(n, sharding.FAN_IN))
        before = sum(v for (t, _), w in want.items() if t == tier for v in (size[x] for x in w))
        want.setdefault((tier, (before + n - 1) // 5000), []).append(name)
    assert sorted(sorted(r.shards) for r in s.plan(1).collect()) == sorted(map(sorted, want.values()))
    monkeypatch.setattr(sharding, "PLANNED", 20)  # now in many blocks: other runs, as contiguous
    runs = [(r.tier, r.run, list(r.shards)) for r in s.plan(1).collect()]
    assert sorted(x for _, _, names in runs for x in names) == sorted(arrived)
    for tier in {t for t, _, _ in runs}:
        line = [names for t, _, names in sorted(runs) if t == tier]
        assert all(max(arrived[x] for x in a) <= min(arrived[x] for x in b) for a, b in zip(line, line[1:]))
        assert all(sum(size[x] for x in names) < 5000 + 1700 for names in line)


def test_query_with_a_clashing_column(spark, odd, tmp_path):
    odd.withColumn("shard", F.lit("mine")).withColumn("shard_", F.lit(1)).drop("a.b").write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_sharding(spark, str(tmp_path))
    assert got.count() == odd.count() and "mine" not in {r.shard for r in got.collect()}
