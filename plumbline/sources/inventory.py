"""Files as a relation: what documents name, what is there, and what changed between two looks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import Tables

FILE = "path string, length long, modified timestamp"


def plain_path(path: Column) -> Column:
    """A path as documents write it: without the scheme of the file system that Spark puts before local ones."""
    return F.regexp_replace(path, "^file:(//)?(?=/)", "")


def _blocks(rows: Iterator, size: int) -> Iterator[list[str]]:
    while block := [r[0] for r in islice(rows, size)]:
        yield block


def listing(spark: SparkSession, paths: DataFrame, *, path_col: str = "path", block: int = 1_000) -> DataFrame:
    """(path, length, modified) of the files among `paths` that are there; contents are not read.

    The folders of the paths are listed, `block` of them at a time, and files meet paths by equality; folders that are not there, and
    null paths, are left out.
    """
    tables = Tables(spark)
    wanted = tables.put(paths.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path")).distinct())
    found = spark.createDataFrame([], FILE)
    folders = wanted.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("f")).where("f <> ''").distinct()
    for some in _blocks(folders.toLocalIterator(), block):
        there = [f for f in some if _is_folder(spark, f)]
        if there:
            files = spark.read.format("binaryFile").load(there).select(plain_path(F.col("path")).alias("path"), "length", F.col("modificationTime").alias("modified"))
            found = found.unionByName(files)
    return found.join(wanted, "path", "left_semi")


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def hashed(spark: SparkSession, files: DataFrame, *, block: int = 10_000) -> DataFrame:
    """files (path, length, modified) with sha256; only these files are opened, `block` of them at a time."""
    tables = Tables(spark)
    files = tables.put(files.select("path", "length", "modified"))
    found = spark.createDataFrame([], "path string, sha256 string")
    for some in _blocks(files.select("path").toLocalIterator(), block):
        own = spark.read.format("binaryFile").load(some).select(plain_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"))
        found = found.unionByName(own)
    return files.join(found, "path", "left")


def look_again(spark: SparkSession, before: DataFrame, now: DataFrame) -> DataFrame:
    """now (path, length, modified) with sha256, taken from `before` (the same with sha256) where neither size nor time differs."""
    same = now.join(before.select("path", "length", "modified", "sha256"), ["path", "length", "modified"], "left")
    fresh = hashed(spark, same.where("sha256 IS NULL").select("path", "length", "modified"))
    return same.where("sha256 IS NOT NULL").select("path", "length", "modified", "sha256").unionByName(fresh.select("path", "length", "modified", "sha256"))


def changes(before: DataFrame, after: DataFrame, *, key: str = "path", digest: str = "sha256", signs: list[str] = ("length", "modified")) -> DataFrame:
    """(key, status) of what two looks differ in: "added", "removed", "changed" by digest, "touched" by a sign only, "unknown".

    One full join by key.  A null digest on either side is unknown, whatever the signs say; keys must be unique, and null keys
    are no files.  Equal files have no row.
    """
    a = before.where(F.col(key).isNotNull()).select(key, F.struct(digest, *signs).alias("__a"))
    b = after.where(F.col(key).isNotNull()).select(key, F.struct(digest, *signs).alias("__b"))
    moved = F.lit(False)
    for s in signs:
        moved = moved | ~F.col(f"__a.{s}").eqNullSafe(F.col(f"__b.{s}"))
    x, y = F.col(f"__a.{digest}"), F.col(f"__b.{digest}")
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(x.isNull() | y.isNull(), "unknown").when(x != y, "changed").when(moved, "touched")
    return a.join(b, key, "full_outer").select(key, status.alias("status")).where("status IS NOT NULL")
