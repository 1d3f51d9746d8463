"""Size-tiered compaction of immutable shards under versioned manifests.

Arrivals are written as many small Parquet shards at once. Compaction looks at
the manifest alone: live shards below the target fall into tiers by size,
neighbours of one tier (in order of arrival) form runs of at most the target
size, and a run of enough shards becomes one file. A run is read and written
by one task, so no row is shuffled, and that task's work is bounded by the
target.

Each change writes a whole new manifest beside the others and commits it by
renaming its folder to its version, which fails if that version exists: a
version is there with all its content or not at all, and of two writers one
gets a :class:`CommitConflict`. A writer that dies leaves files that no version
names. Readers see the old version until the rename and whole files after.

Data moves by DataFrame reads and writes only. The driver handles names of
shards, a few runs at a time; a read of a version names its files, as any read
does.

Defined cases: nulls, empty and very long texts are rows like any other; ties
and repeated rows are all kept; an empty arrival commits a version without new
shards; columns of type void become strings; other columns pass through,
whatever their names.
"""

from __future__ import annotations

import uuid
from functools import reduce
from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.llm.shared import materialize, release

#: Bytes of a merged file, rows of an arriving shard, ratio of tiers, least
#: shards in a run, and runs that one Spark job merges.
TARGET, ARRIVAL_ROWS, FAN_IN, LEAST_RUN, AT_ONCE = 128 << 20, 2000, 4, 4, 64
#: Shards of one arrival that are planned in one window's partition.
PLANNED = 50_000
MANIFEST = "shard string, level int, arrived long, n_rows long, n_bytes long"


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """Versioned shards of one schema below ``root``, a shared folder."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET) -> None:
        self.spark, self.root, self.target = spark, root.rstrip("/"), target

    def _path(self, name: str) -> tuple:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _none(self, schema: T.StructType) -> DataFrame:
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def versions(self) -> list[int]:
        """Committed versions that are kept, in order."""
        fs, where = self._path("manifests")
        names = (s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else ()
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """The last committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """Live shards: name, level (merges behind it), arrival, rows, bytes."""
        version = self.version() if version is None else version
        if not version:
            return self._none(T.StructType.fromDDL(MANIFEST))
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{version:020d}")

    def _commit(self, shards: DataFrame, version: int) -> int:
        """Publish ``shards`` as ``version``; see the module for what is atomic."""
        mine = uuid.uuid4().hex
        shards.write.parquet(f"{self.root}/manifests/_{mine}")
        fs, new = self._path(f"manifests/_{mine}")
        fs.create(self._path(f"manifests/_{mine}/_owner-{mine}")[1], False).close()
        _, final = self._path(f"manifests/{version:020d}")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(new), fs.makeQualified(final), plain)
        except Py4JJavaError as failed:
            if not fs.exists(final):
                raise
            raise CommitConflict(f"version {version} exists") from failed
        if not fs.exists(self._path(f"manifests/{version:020d}/_owner-{mine}")[1]):
            raise CommitConflict(f"version {version} is another writer's")
        return version

    def _described(self, data: DataFrame, level: int, arrived: int) -> DataFrame:
        meta = data.metadataColumn("_metadata")
        return data.select(meta["file_path"].alias("shard"), meta["file_size"].alias("n_bytes")).groupBy("shard", "n_bytes").agg(F.count("*").alias("n_rows")).select("shard", F.lit(level).alias("level"), F.lit(arrived).cast("long").alias("arrived"), "n_rows", "n_bytes")

    def append(self, rows: DataFrame, shard_rows: int = ARRIVAL_ROWS) -> int:
        """Write one arrival as small shards and commit it."""
        kept = rows.withColumns({f"`{c}`" if "." in c else c: F.col(f"`{c}`").cast("string") for c, kind in rows.dtypes if kind == "void"})
        version = self.version() + 1
        path = f"{self.root}/data/arrival-{version}-{uuid.uuid4().hex}"
        kept.write.option("maxRecordsPerFile", shard_rows).option("compression", "zstd").parquet(path)
        new = self._described(self.spark.read.schema(kept.schema).parquet(path), 0, version)
        return self._commit(self.manifest(version - 1).unionByName(new), version)

    def plan(self, least: int = LEAST_RUN) -> DataFrame:
        """Runs to merge: (run, shards, level, arrived) of similar neighbours.

        Shards of a tier lie in a line by arrival, and a run is what lies
        within one target size of it. Sums along the line come in two levels,
        of arrivals and within each (an arrival of many shards in blocks, by a
        hash of their names), so no window holds a tier. A run takes its
        shards' names; their number is bounded by the target size over the
        smallest shard's.
        """
        live = self.manifest().where(F.col("n_bytes") < self.target)
        blocks = max(1, -(-live.count() // PLANNED))
        tier = F.floor(F.log(float(FAN_IN), F.greatest(F.col("n_bytes"), F.lit(1))))
        cut = live.withColumn("block", F.pmod(F.xxhash64("shard"), F.lit(blocks))).withColumn("tier", tier)
        place = ["tier", "arrived", "block"]
        line = Window.partitionBy("tier").orderBy("arrived", "block").rowsBetween(Window.unboundedPreceding, -1)
        before = cut.groupBy(*place).agg(F.sum("n_bytes").alias("bytes")).select(*place, F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("before"))
        by = Window.partitionBy(*place).orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = F.floor((F.col("before") + F.col("upto") - 1) / self.target)
        cut = cut.withColumn("upto", F.sum("n_bytes").over(by)).join(before, place).withColumn("run", run)
        runs = cut.groupBy("tier", "run").agg(F.collect_list("shard").alias("shards"), F.max("level").alias("level"), F.max("arrived").alias("arrived"), F.sum("n_bytes").alias("n_bytes"))
        return runs.where(F.size("shards") >= least)

    def compact(self, schema=None, least: int = LEAST_RUN) -> int:
        """Merge runs of ``least`` shards or more until none is left.

        Returns the last version. A merge that leaves its tier may complete a
        run of the next, which a further round merges.
        """
        while True:
            runs, path = materialize(self.plan(least).select("shards", "level", "arrived"), "runs")
            some = runs.agg(F.max("level"), F.max("arrived")).first()
            if some[0] is None:
                release(self.spark, path)
                return self.version()
            self._merge(runs, schema, some[0] + 1, some[1])
            release(self.spark, path)

    def _merge(self, runs: DataFrame, schema, level: int, arrived: int) -> None:
        version = self.version() + 1
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        path = f"{self.root}/data/merge-{version}-{uuid.uuid4().hex}"
        names = (r["shards"] for r in runs.select("shards").toLocalIterator())
        while some := list(islice(names, AT_ONCE)):
            parts = [reader.parquet(*shards).coalesce(1) for shards in some]
            reduce(DataFrame.union, parts).write.mode("append").option("compression", "zstd").parquet(path)
        new = self._described(reader.parquet(path), level, arrived)
        gone = runs.select(F.explode("shards").alias("shard"))
        self._commit(self.manifest(version - 1).join(gone, "shard", "left_anti").unionByName(new), version)

    def read(self, schema: T.StructType, version: int | None = None, shard_as: str | None = None) -> DataFrame:
        """Rows of a version; on demand with the shard each lies in.

        The name for that must be free.
        """
        if shard_as and shard_as.lower() in (n.lower() for n in schema.names):
            raise ValueError(f"the rows have a column {shard_as} of their own")
        names = [r[0] for r in self.manifest(version).select("shard").toLocalIterator()]
        data = self.spark.read.schema(schema).parquet(*names) if names else self._none(schema)
        if not shard_as:
            return data
        return data.withColumn(shard_as, data.metadataColumn("_metadata")["file_path"] if names else F.lit(None).cast("string"))

    def expire(self) -> None:
        """Delete older versions, and shards that only they name.

        Manifests go last, so that a run cut short can be repeated.
        """
        *old, last = self.versions() or [0]
        if not old:
            return
        named = reduce(DataFrame.union, [self.manifest(v).select("shard") for v in old]).distinct()
        fs, _ = self._path("data")
        for r in named.join(self.manifest(last).select("shard"), "shard", "left_anti").toLocalIterator():
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.spark._jvm.java.net.URI(r[0])), False)
        for v in old:
            fs.delete(self._path(f"manifests/{v:020d}")[1], True)
