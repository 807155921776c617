"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(vocab: str) -> str:
    """The file of a vocabulary: an absolute path as it is, else one of the public ones.

    Called on the worker, whose installation may differ from the driver's.
    """
    if os.path.isabs(vocab):
        return vocab
    import public_tokenizers

    return public_tokenizers.path(vocab)


def shared_dir(spark: SparkSession) -> str:
    """The folder which the driver and all executors share.

    It is the one the cluster names in spark.checkpoint.dir.  Where the setting is absent, as
    in tests, a temporary folder serves if all work runs on this machine; a cluster without
    the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder which the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Work before it isn't repeated, and a lost executor loses none of it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    release()
    _folders[id(out)] = (weakref.ref(out), path)
    return out


#: Where the tables written by ``durable`` are, for as long as the driver's program holds them.
_folders: dict[int, tuple[weakref.ref, str]] = {}


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables returned by ``durable``, once all that reads them is written itself."""
    for t in tables:
        held, path = _folders.pop(id(t), (lambda: None, ""))
        if held() is t:
            spark = t.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` which the table doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: What a worker process has loaded for its tasks, by loader and argument: one thing at most.
_loaded: dict[tuple, object] = {}


def loaded(make: Callable, argument):
    """``make(argument)``, kept by the worker until a task needs something else."""
    key = (make.__module__, make.__qualname__, argument)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = make(argument)
    return _loaded[key]


def lean(fn: Callable, keeps: bool = False) -> Callable:
    """``fn`` for mapInArrow, by a worker which gives back its memory between tasks.

    Workers serve many stages, and an allocator would keep what one of them needed.  What
    has been loaded goes too, unless the function ``keeps`` it for its next task.
    """

    def run(batches):
        from . import common

        if not keeps:
            common._loaded.clear()
        try:
            yield from fn(batches)
        finally:
            common.release()

    return run


#: Bytes of an Arrow batch to a worker, unless the session names its own: a batch is held several
#: times over, by the executor and by its worker.
BATCH_BYTES = "8m"


def map_arrow(df: DataFrame, fn: Callable, schema, keeps: bool = False) -> DataFrame:
    """mapInArrow by lean workers, in batches of bounded size."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(conf, None) in (None, "67108864b", "64MB"):
        df.sparkSession.conf.set(conf, BATCH_BYTES)
    return df.mapInArrow(lean(fn, keeps), schema)


def release() -> None:
    """Returns freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        return


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_batches(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str) -> DataFrame:
    """Runs ``fn`` on the columns of each Arrow batch, as Python lists.

    ``fn`` yields dicts of columns in the order of ``schema``; it may yield several for a
    batch, so that its output stays small in memory.
    """
    spark = df.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch):
                for part in fn(*[c.to_pylist() for c in batch.slice(a, b - a).columns]):
                    yield pa.RecordBatch.from_arrays([pa.array(part[f.name], f.type) for f in arrow], schema=arrow)

    return map_arrow(df, run, schema, keeps=True)


def pieces(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text and binary together (one row may be larger)."""
    size = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from ((a, b) for a, b in zip(cuts, cuts[1:]) if a < b)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
