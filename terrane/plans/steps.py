"""Steps of iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a folder of our own only where it is unset and all tasks run in this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file:///tmp/checkpoints").rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def step(df: DataFrame) -> DataFrame:
    """df, written to the folder that the cluster shares and read again: the plan stays short and lost executors lose nothing."""
    spark = df.sparkSession
    path = fresh_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, column: str, keys: DataFrame, name: str, most_sent: int = 100_000, most_bits: int = 2**28) -> DataFrame:
    """rows with a boolean name: whether column may be one of keys (one column, a step). True for all that are and, of the
    others, for a sixteenth at most or, beyond 16 million keys, for more; so an exact join follows.

    Up to most_sent keys are sent as they are. Of more, a bit of each one's hash is sent, in blocks of 1024 words: 32 MB at
    most, whatever their number.
    """
    keys = keys.toDF("__key").where("__key is not null")
    n = keys.count()
    if n <= most_sent:
        met = rows.join(F.broadcast(keys.distinct()), F.col(column) == F.col("__key"), "left")
        return met.withColumn(name, F.col("__key").isNotNull()).drop("__key")
    bits = min(most_bits, 1 << (16 * n - 1).bit_length())
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = keys.select(place("__key").alias("h")).select(F.shiftright("h", 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("x"))
    words = words.unionByName(rows.sparkSession.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))).groupBy("w").agg(F.bit_or("x").alias("x"))
    blocks = words.groupBy(F.shiftright("w", 10).alias("__block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s.x).alias("__words"))
    h = place(column)
    word = F.get("__words", F.shiftright(h, 6).bitwiseAND(F.lit(1023)).cast("int"))
    met = rows.join(F.broadcast(blocks), F.shiftright(h, 16) == F.col("__block"))
    return met.withColumn(name, F.getbit(word, h.bitwiseAND(F.lit(63)).cast("int")) == 1).drop("__block", "__words")


def among(rows: DataFrame, column: str, keys: DataFrame, most_sent: int = 100_000) -> DataFrame:
    """rows whose column may be one of keys (one column, a step), as marked() says: an exact join follows, to which the rest
    needn't travel. With up to most_sent keys Spark filters below unions and distinct rows."""
    if keys.count() <= most_sent:
        return rows.join(F.broadcast(keys.toDF("__key").distinct()), F.col(column) == F.col("__key"), "left_semi")
    return marked(rows, column, keys, "__may", most_sent).where("__may").drop("__may")
