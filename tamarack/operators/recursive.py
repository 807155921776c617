"""Recursive queries with UNION: rows already seen don't come back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rounds after which a recursion counts as endless.
MOST_ROUNDS = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it;
    where it is unset, as in tests, a temporary one if all work runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder which the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixpoint(anchor: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = MOST_ROUNDS) -> DataFrame:
    """WITH RECURSIVE r AS (anchor UNION step(r)): the step sees only the rows new in the
    last round, and rows equal to earlier ones (nulls being equal) are dropped.

    New rows are found by set difference, a shuffle on the rows; each round is written, so
    plans don't grow with the rounds.
    """
    delta = written(anchor.distinct())
    seen = delta
    for _ in range(rounds):
        delta = written(step(delta).toDF(*seen.columns).subtract(seen))
        if delta.isEmpty():
            return seen
        seen = seen.union(delta)
    raise RuntimeError(f"the recursion has not ended after {rounds} rounds")
