"""What the operators share: the shared folder, tables written between steps, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. One of our own only where the session names none and all its tasks run in
    this process, as in tests; a cluster has to name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """name, or with lines after it as many as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Tables that steps wrote and that weren't dropped yet.
MADE: list[Written] = []


class Written:
    """A step's table, written to the shared folder: lost executors lose nothing, and no step is computed twice."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark, self.path = df.sparkSession, fresh_path(df.sparkSession, tag)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        MADE.append(self)

    def drop(self) -> None:
        """Only after nothing that is still to be read depends on it."""
        if self in MADE:
            MADE.remove(self)
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(before: int = 0, keep: DataFrame | None = None) -> None:
    """Drops the tables written since `before` (a length of MADE), once their readers' results are written themselves."""
    for table in MADE[before:]:
        if table.df is not keep:
            table.drop()


def trim() -> None:
    """Gives freed memory back: Python workers stay for the next tasks, beside the executor's JVM."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(f):
    """A function for mapInArrow that trims memory when a task ends."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def written(df: DataFrame, tag: str) -> DataFrame:
    return Written(df, tag).df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def count_min(df: DataFrame, cols: list[str]) -> tuple:
    return df.agg(F.count(F.lit(1)), *[F.min(c) for c in cols]).first()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component), the least id each node reaches.

    Each round hooks every root to the least root that its nodes' neighbours have, then jumps pointers; roots
    form chains that halve, so the rounds grow with the logarithm of the longest path. Labels go through
    aggregates that combine before the shuffle and joins that Spark may split, so a node with many edges is no
    hot spot. Nodes without edges don't appear. Each round is a written table, and nothing is collected.
    """
    both = Written(
        edges.where("a is not null and b is not null and a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        f"{tag}-edges",
    )
    labels = Written(
        both.df.select(F.explode(F.array("a", "b")).alias("node"), "a").groupBy("node").agg(F.min("a").alias("component")),
        f"{tag}-labels",
    )
    while True:
        at_a = labels.df.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        at_b = labels.df.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        hooks = (
            both.df.join(at_a, "a")
            .join(at_b, "b")
            .where("ca != cb")
            .select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("to"))
            .groupBy("root")
            .agg(F.min("to").alias("to"))
        )
        hooked = Written(hooks, f"{tag}-hooks")
        if hooked.df.isEmpty():
            hooked.drop()
            both.drop()
            return labels.df
        # Hooks go from larger to smaller roots, so they have no cycles; three jumps shorten chains eightfold.
        up = hooked.df
        for _ in range(3):
            further = up.select(F.col("root").alias("to"), F.col("to").alias("further"))
            up = up.join(further, "to", "left").select("root", F.coalesce("further", "to").alias("to"))
        jumped = labels.df.join(up.withColumnRenamed("root", "component"), "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")
        )
        last, labels = labels, Written(jumped, f"{tag}-labels")
        last.drop()
        hooked.drop()
