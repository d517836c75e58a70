"""What the training-data operators share: tables in the shared folder, naming, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session on one machine (tests, benchmarks) takes a local folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-ck-"))
        folder = sc.getCheckpointDir()
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder; order and partitioning stay known.

    A checkpoint is in shared storage, so a lost executor costs nothing but the task it ran.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Tables of one run in the shared folder: compressed, columnar, and gone when they are dropped.

    Like a checkpoint a table cuts lineage and survives lost executors; unlike one it is small and its end is known.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path, _ = self.paths[id(df)]
            remove(self.spark, path)

    def drop_all(self, *but: DataFrame) -> None:
        for key, (path, _) in self.paths.items():
            if key not in {id(df) for df in but}:
                remove(self.spark, path)


_KEPT: dict[str, tuple[object, object]] = {}


def kept(name: str, make: Callable[[], object], version: object = None) -> object:
    """What a Python worker keeps for one operator between tasks; another version takes the place of the last."""
    if name not in _KEPT or _KEPT[name][0] != version:
        _KEPT[name] = version, make()
    return _KEPT[name][1]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like `wanted` that clash with no column of df (case does not count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links between longs: (node, component), component the smallest node.

    Alternating star contraction: each round replaces every node's links by links to its smallest neighbour, first
    from larger neighbours, then within the smaller ones, until nothing changes; the number of rounds grows with the
    logarithm of the longest chain.  Each round is a grouped minimum (combined before the shuffle) and a join on the
    node, which AQE splits where a node has very many links.  Nodes that no link touches are not returned; null ends and
    loops are ignored; repeated links count once; no links give no rows.
    """
    kept_tables = Tables(links.sparkSession)
    edges = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    edges = kept_tables.put(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        # done if every u has one v, and no v is a u
        ends = edges.select(F.col("u").alias("x"), F.lit(3).alias("k")).union(edges.select("v", F.lit(4)).distinct())
        if ends.groupBy("x").agg(F.sum("k").alias("k")).where("k > 4").isEmpty():
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above u point to u's least
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept_tables.put(large.distinct())
        kept_tables.drop(edges)
        # small star: u and its neighbours below point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = kept_tables.put(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        kept_tables.drop(large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
