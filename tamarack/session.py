"""Sessions and the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Settings for any size: adaptive plans, split skewed joins, pushed aggregates, UTC like the dialect's clock.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; others may be added or override them."""
    builder = SparkSession.builder.appName("tamarack").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


#: Schemas by path, so that a table's files are asked for theirs once and not by every query.
_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


#: Bytes of source files whose rows one task may hold to sort them; they take ten times that and more.
PART_BYTES = 8 << 20


def width(df: DataFrame) -> int:
    """Into how many parts of PART_BYTES the sources of a plan go, so that tasks stay as large
    when tables grow; 0 where a source doesn't know its size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return 0 if total >= 1 << 62 else -(-total // PART_BYTES)


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Makes tables of a folder views of the session; a query keeps what it was analysed with."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
