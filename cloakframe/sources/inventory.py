"""Listing objects and partitions of a storage location.

The listing is a DataFrame: Spark lists large trees in parallel and the file
contents are never read (the ``content`` column is pruned).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.sql import lit


# Content types by file name extension.
CONTENT_TYPES = {
    "csv": "text/csv",
    "json": "application/json",
    "txt": "text/plain",
    "log": "text/plain",
    "html": "text/html",
    "xml": "application/xml",
    "pdf": "application/pdf",
    "gz": "application/gzip",
    "zip": "application/zip",
    "parquet": "application/vnd.apache.parquet",
    "avro": "application/avro",
    "orc": "application/x-orc",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"


def objects(spark: SparkSession, bucket: str) -> DataFrame:
    """``path, key, size_bytes, last_modified, content_type`` of everything below a location."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(bucket)
        .select("path", "length", "modificationTime")
    )
    root = bucket.split("://", 1)[-1].split(":", 1)[-1].strip("/")
    # the key is what follows the location in the path
    key = F.expr(f"substring(path, instr(path, {lit(root + '/')}) + {len(root) + 1})")
    extension = F.lower(F.substring_index(F.col("key"), ".", -1))
    kind = F.element_at(F.create_map(*[F.lit(v) for pair in CONTENT_TYPES.items() for v in pair]), extension)
    return files.withColumn("key", key).select(
        "path",
        "key",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("last_modified"),
        F.coalesce(kind, F.lit(DEFAULT_CONTENT_TYPE)).alias("content_type"),
    )


def allowed(listing: DataFrame, prefixes: list[str] | None, column: str = "key") -> DataFrame:
    """Only objects below an allowed prefix; no list allows all."""
    if not prefixes:
        return listing
    return listing.where(reduce(Column.__or__, [F.col(column).startswith(p) for p in prefixes]))


def allowed_by_table(listing: DataFrame, prefixes: DataFrame, column: str = "key", depth: int = 1) -> DataFrame:
    """As ``allowed`` for a long list: a semi join on the first ``depth`` path parts.

    ``prefixes`` has one column of prefixes that end at a path part (``a/`` or
    ``a/b/`` for depth 1 or 2), so the match is an equi-join that can shuffle.
    """
    wanted = prefixes.select(F.col(prefixes.columns[0]).alias("__prefix")).distinct()
    cut = F.concat(F.substring_index(F.col(column), "/", depth), F.lit("/"))
    return listing.join(wanted, cut == F.col("__prefix"), "left_semi")


def longest_prefix(listing: DataFrame, prefixes: DataFrame, column: str = "key") -> DataFrame:
    """``listing`` with ``matched_prefix``, the longest allowed prefix of each object (null: none), for long lists of prefixes of any lengths.

    ``prefixes`` has one column of texts. A key is cut at the lengths that prefixes have, at
    most as many as the longest prefix has characters, and the pieces are looked up by an
    equi-join. Keys that repeat are looked up once. Null keys and prefixes match nothing; the
    empty prefix matches every key.
    """
    wanted = prefixes.select(F.col(prefixes.columns[0]).cast("string").alias("__prefix")).where("__prefix IS NOT NULL").distinct()
    lengths = [r[0] for r in wanted.select(F.char_length("__prefix")).distinct().orderBy(F.char_length("__prefix")).collect()]
    if not lengths:
        return listing.withColumn("matched_prefix", F.lit(None).cast("string"))
    keys = listing.select(F.col(column).alias("__key")).where("__key IS NOT NULL").distinct()
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length("__key"))
    cut = keys.select("__key", F.explode(fitting).alias("__n")).withColumn("__prefix", F.expr("substring(__key, 1, __n)"))
    best = cut.join(wanted, "__prefix").groupBy("__key").agg(F.max_by("__prefix", "__n").alias("matched_prefix"))
    return listing.join(best, F.col(column) == F.col("__key"), "left").drop("__key")


def allowed_by_prefixes(listing: DataFrame, prefixes: DataFrame, column: str = "key") -> DataFrame:
    """As ``allowed`` for a long list of prefixes of any lengths; an empty list allows nothing."""
    return longest_prefix(listing, prefixes, column).where("matched_prefix IS NOT NULL").drop("matched_prefix")


def check_bucket(bucket: str, allowed_buckets: list[str] | None) -> str:
    if allowed_buckets and bucket not in allowed_buckets:
        raise PermissionError(f"bucket '{bucket}' is not allowed: {sorted(allowed_buckets)}")
    return bucket


def check_prefix(prefix: str, allowed_prefixes: list[str] | None) -> str:
    if allowed_prefixes and not prefix.startswith(tuple(allowed_prefixes)):
        raise PermissionError(f"prefix '{prefix}' is not allowed: {sorted(allowed_prefixes)}")
    return prefix


def list_objects(
    spark: SparkSession,
    bucket: str,
    prefix: str = "",
    limit: int | None = None,
    allowed_buckets: list[str] | None = None,
    allowed_prefixes: list[str] | None = None,
) -> DataFrame:
    """Objects below a prefix, by key; ``limit`` is the caller's page size."""
    check_bucket(bucket, allowed_buckets)
    check_prefix(prefix, allowed_prefixes)
    found = objects(spark, bucket).where(F.col("key").startswith(prefix))
    return found.orderBy("key").limit(limit) if limit is not None else found


def list_prefixes(listing: DataFrame, prefix: str = "", delimiter: str = "/") -> DataFrame:
    """Common prefixes one level below ``prefix``, like folders."""
    rest = F.substr(F.col("key"), F.lit(len(prefix) + 1))
    return (
        listing.where(F.col("key").startswith(prefix) & rest.contains(delimiter))
        .select(F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter)).alias("prefix"))
        .distinct()
        .orderBy("prefix")
    )


def list_partitions(listing: DataFrame, limit: int | None = None) -> DataFrame:
    """``values, location, creation_time`` of a table laid out in ``name=value`` folders.

    Built from the file listing, so no data file is opened.
    """
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    values = F.transform(
        F.regexp_extract_all(F.col("key"), F.lit(r"([^/=]+)=([^/]*)/"), F.lit(2)), lambda v: F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B")))
    )
    found = (
        listing.where(F.col("key").rlike(r"^(?:[^/=]+=[^/]*/)+[^/_.][^/]*$"))
        .groupBy(values.alias("values"), folder.alias("location"))
        .agg(F.min("last_modified").alias("creation_time"))
    )
    return found.orderBy("location").limit(limit) if limit is not None else found
