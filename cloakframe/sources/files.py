"""Reading file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None) -> DataFrame:
    """A table from files; Spark splits large files by itself.

    A file that is one row group (or one unsplittable archive) is one task.  A
    caller who knows that its rows are costly can have them dealt out to
    ``partitions`` tasks, at the price of one shuffle of the table.
    """
    df = spark.read.format(fmt).load(path)
    return df if partitions is None else df.repartition(partitions)


def stream_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table as a stream of its files, whether ``path`` is one file or a folder of files.

    A folder may hold folders of a column's values. The path of a file goes in as a pattern that only it matches: a
    stream takes a plain path for a folder, and a pattern's folders for no columns.
    """
    schema = read_table(spark, path, fmt).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not (fs.exists(at) and fs.getFileStatus(at).isDirectory()):
        folder, _, name = path.rstrip("/").rpartition("/")
        path = f"{folder}/[{name[0]}]{name[1:]}"
    return spark.readStream.schema(schema).format(fmt).load(path)
