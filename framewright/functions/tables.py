"""Tables that cut a long lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of tables that this driver has written and not yet deleted.
_written: set[str] = set()
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Where it names none, a run in one machine's process (tests, a laptop) uses
    a folder of its own, which goes with the process; on a cluster that is an
    error, since no local folder would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-tables-"))
        atexit.register(_forget, os.getpid())
    return _own[0]


def _forget(owner: int) -> None:
    if os.getpid() == owner:
        shutil.rmtree(_own[0], ignore_errors=True)


def write(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and its path.

    For rows that an operator reads several times, each time behind windows
    and joins: the plan stays small, the work is done once, and a lost
    executor costs a read of files. Columns of type void become strings, as
    Parquet has no such type.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    kept = df.withColumns({f"`{c}`" if "." in c else c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    _written.add(path)
    kept.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(kept.schema).parquet(path), path


def settled(df: DataFrame, tag: str) -> DataFrame:
    """As :func:`write`, without the path: :func:`sweep` deletes the table."""
    return write(df, tag)[0]


#: Tables that several queries of an application read, by what they hold.
_kept: dict[tuple[str, ...], tuple[DataFrame, str]] = {}


def stamp(spark: SparkSession, path: str) -> str:
    """When files under a path were last written, and their lengths: another
    text once the table there is rewritten."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return "absent"
    top = fs.getFileStatus(where)
    inner = [f for f in fs.listStatus(where) if not f.getPath().getName().startswith(("_", "."))] if top.isDirectory() else [top]
    return f"{len(inner)}:{sum(f.getLen() for f in inner)}:{max((f.getModificationTime() for f in inner), default=0)}"


def kept(spark: SparkSession, key: tuple[str, ...], build: Callable[[], DataFrame], source: str | None = None) -> DataFrame:
    """The table of ``key``, built and written by the first who asks.

    For what is read in and shaped once and then queried many times; it lasts
    as long as the application, or until :func:`sweep`. A table derived from
    the files at ``source`` is built anew once those have changed.
    """
    at = (spark.sparkContext.applicationId, *key, stamp(spark, source) if source else "")
    if at not in _kept:
        _kept[at] = write(build(), key[0])
    return _kept[at][0]


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables of :func:`write` that nothing reads any more."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _written.discard(p)
    for at in [k for k, (_, p) in _kept.items() if p in paths]:
        del _kept[at]


def sweep(spark: SparkSession) -> None:
    """Delete all tables this driver has left.

    For the caller, once every result that reads them is written: a result is
    a plan over these tables until then.
    """
    release(spark, *list(_written))
