"""Results as JSON, and the files below a folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the sidecar of a result tells, so that a listing need not open it.
SIDECAR = "name string, sections array<string>, frames long, start_us long, end_us long"


def write_result(frames: DataFrame, sections: Mapping[str, DataFrame], path: str, name: str) -> None:
    """Each section as a folder of JSON lines, and a sidecar of one line.

    Sections keep their nested columns; nulls are left out of a line. No
    section is held whole anywhere.
    """
    for section, rows in sections.items():
        rows.write.mode("errorifexists").json(f"{path}/{section}")
    told = frames.agg(F.count("*").alias("frames"), F.min("epoch_us").alias("start_us"), F.max("epoch_us").alias("end_us"))
    listed = F.array(*map(F.lit, sorted(sections))) if sections else F.array().cast("array<string>")
    told.select(F.lit(name).alias("name"), listed.alias("sections"), "frames", "start_us", "end_us").coalesce(1).write.json(f"{path}/_about")


def list_results(spark: SparkSession, root: str) -> DataFrame:
    """Sidecars of all results below a folder, the latest capture first."""
    # Names with an underscore are hidden from a plain read, so they are globbed.
    return spark.read.schema(SIDECAR).json(f"{root}/*/_about/part-*").orderBy(F.desc("start_us"), "name")


def read_section(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """One section of a result; absent fields are null."""
    return spark.read.schema(schema).json(f"{path}/{section}")


def discovered(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files below a folder, at any depth, whose name fits: path and size."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", F.col("length").alias("bytes"), "modificationTime").orderBy("path")
