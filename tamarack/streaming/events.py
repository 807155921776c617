"""Event-time operators on streams; each works on a batch as well."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


#: Rows of a file written for a stream, and files of a batch: a batch's ids are state, so both bound it.
FILE_ROWS, BATCH_FILES = 500_000, 8


def write_events(events: DataFrame, folder: str, file_rows: int = FILE_ROWS, batch_files: int = BATCH_FILES) -> int:
    """Writes a table as files that a stream takes in the order of ``ts``; returns how many files a batch may have.

    Each file is a range of time; their rows needn't be sorted, for watermarks move between
    batches.  A stream takes files by modification time, so those are set in the order of the
    ranges.  Where the store doesn't keep them so, one batch takes all files, since rows of
    a batch out of order would count as late.
    """
    parts = max(1, -(-events.count() // file_rows))
    events.repartitionByRange(parts, "ts", "event_id").write.option("maxRecordsPerFile", 0).parquet(folder)
    spark = events.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    listed = lambda: sorted((f for f in fs.listStatus(place) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())
    files = listed()
    times = [files[0].getModificationTime() // 1000 * 1000 + 1000 * i for i in range(len(files))] if files else []
    try:
        for f, at in zip(files, times):
            fs.setTimes(f.getPath(), at, -1)
        kept = [f.getModificationTime() for f in listed()] == times
    except Py4JJavaError:
        kept = False
    return batch_files if kept else max(1, len(files))


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder, with ``at`` as event time."""
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return events.withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str, late: str = "10 minutes") -> DataFrame:
    """Count and sum of values by kind in windows of one width; rows later than ``late`` are dropped."""
    marked = events.withWatermark("at", late) if events.isStreaming else events
    return marked.groupBy(F.window("at", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str = "10 minutes") -> DataFrame:
    marked = events.withWatermark("at", late) if events.isStreaming else events
    return marked.groupBy(F.window("at", width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events with no gap as long as ``gap``."""
    marked = events.withWatermark("at", late) if events.isStreaming else events
    return marked.groupBy("user_id", F.session_window("at", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeated ids."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def drain(stream: DataFrame, folder: str, mode: str = "append") -> None:
    """Runs a stream over what is there now into a folder of Parquet files."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/_state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
