"""Readers and writers of the graph's files, on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import upsert
from .schemas import SEEDS


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed entities of a CSV file with a header; aliases become an array. A byte order mark is dropped."""
    seeds = spark.read.schema(SEEDS).option("header", True).option("enforceSchema", True).csv(path)
    return seeds.withColumn("aliases", F.filter(F.split(F.coalesce("aliases", F.lit("")), r"\|"), lambda x: x != ""))


def read_records(spark: SparkSession, path: str, schema: str, strict: bool = True, lines: bool = False) -> DataFrame:
    """A JSON array of records, or a record a line as write_records writes them. Strict: a missing file raises
    FileNotFoundError; else it is empty, as is a damaged one."""
    if not exists(spark, path):
        if strict:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", mode).json(path)


def write_seeds(seeds: DataFrame, path: str) -> None:
    """Seeds as CSV files, each with a byte order mark before its header, so that spreadsheets read them as UTF-8."""
    rows = seeds.withColumn("aliases", F.array_join("aliases", "|")).select("input_name", "wikidata_id", "canonical_name", "aliases")
    rows.withColumnRenamed("input_name", "\ufeffinput_name").write.mode("overwrite").option("header", True).csv(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("subject string, predicate string, object string").option("header", True).csv(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_triples(df: DataFrame, path: str) -> None:
    df.select("subject", "predicate", "object").write.mode("overwrite").option("header", True).csv(path)


def write_upserted(new: DataFrame, path: str, keys: list[str], staged: str) -> DataFrame:
    """Upserts new into the Parquet table at path: the result is written to staged, a fresh place, and returned."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], new.schema)
    upsert(old, new, keys).write.mode("overwrite").parquet(staged)
    return spark.read.parquet(staged)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes, and edges by relation, so that a filter on relations reads only theirs."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_graph wrote: nodes and edges."""
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").select("source", "relation", "target")


def tolerant_json(text: Column) -> Column:
    """A JSON value, with or without a code fence around it; null if it isn't JSON."""
    return F.try_parse_json(F.trim(F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")))
