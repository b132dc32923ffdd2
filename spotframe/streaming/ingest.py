"""Files of spots as a stream: exactly-once append, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.session import table


def file_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 100) -> DataFrame:
    """A table's files as a stream, in the order in which they arrive.

    The table is a folder of files or one file; the file system that holds it is asked which.
    """
    schema = table(spark, sf_dir, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet") if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def append_once(stream: DataFrame, out: str) -> None:
    """Write all that is there to a Parquet folder, each file of the source exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], length: str, late: str) -> DataFrame:
    """Rows per window and keys; a window is given out once no later row than ``late`` can fall into it."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def first_deliveries(stream: DataFrame, ident: str, ts: str, late: str) -> DataFrame:
    """Each ``ident`` once; its state is dropped after ``late``."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])
