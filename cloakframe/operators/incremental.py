"""A profile that scans only the files that are new or have changed.

Counters are kept for each source file, as a log of signed rows: a scan adds a file's counters, and
what a file no longer holds is taken back by the same counters with a negative sign. Their sum is
the profile of the files as they are now, so nothing that is unchanged is read again. Every run
writes one folder of the log; a run that was stopped writes the same folder again.

A file counts as the same while its path, time of change and length are. Files that can't be
listed any more are taken back.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.functions.sql import lit
from cloakframe.operators.fields import Scope
from cloakframe.operators.profile import count_columns, unfold_counts
from cloakframe.rules import DEFAULT_RULES, Rules

_FILE = "file string, changed timestamp, length long"
_LOG = f"{_FILE}, path string, column string, pii_type string, n long, sign int, run long"


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file``, ``changed``, ``length`` of the Parquet files of a folder; none is opened."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return listed.select(F.col("path").alias("file"), F.col("modificationTime").alias("changed"), "length")


def _runs(spark: SparkSession, log: str) -> list[int]:
    """Numbers of the runs that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{log}/{n}/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("run=") and done(n))


def _log(spark: SparkSession, log: str) -> DataFrame:
    runs = _runs(spark, log)
    schema = ", ".join(p for p in _LOG.split(", ") if p != "run long")
    if not runs:
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(schema).option("basePath", log).parquet(*[f"{log}/run={r}" for r in runs]).withColumn("run", F.col("run").cast("long"))


def changed_files(spark: SparkSession, folder: str, log: str) -> tuple[DataFrame, DataFrame]:
    """The files to scan, and those to take back (both with file, changed, length)."""
    key = ["file", "changed", "length"]
    known = _log(spark, log).where("path IS NULL").groupBy(*key).agg(F.sum("sign").alias("s")).where("s > 0").drop("s")
    now = source_files(spark, folder)
    return now.join(known, key, "left_anti"), known.join(now, key, "left_anti")


def scan_files(spark: SparkSession, files: list[str], schema, rules: Rules = DEFAULT_RULES, scope: Scope = Scope()) -> DataFrame:
    """``file``, ``path``, ``column``, ``pii_type``, ``n`` of the named files: partial counts per task and file.

    ``path`` is null in the row that says how many rows a file has.
    """
    rows = spark.read.schema(schema).parquet(*[re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files])  # names, not globs
    counters, cells = count_columns(rows, rules, scope)
    counted = counters(rows.withColumn("__file", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))), ["__file"])
    cells = [*cells, (None, None, "CAST(NULL AS STRING)", "rows_scanned")]
    parts = [f"struct(CAST({lit(p)} AS STRING) AS path, CAST({lit(c)} AS STRING) AS column, {t} AS pii_type, {n} AS n)" for p, c, t, n in cells]
    long = counted.selectExpr("__file AS file", f"inline(array({', '.join(parts)}))")
    return long.where("path IS NULL OR n > 0")


def refresh_profile(spark: SparkSession, folder: str, log: str, schema, rules: Rules = DEFAULT_RULES, scope: Scope = Scope()) -> list[str]:
    """Bring the log up to date with the folder; the files that were scanned.

    Their names are what a plan holds of any scan, and all that reaches the driver.
    """
    new, gone = changed_files(spark, folder, log)
    new = new.collect()
    runs = _runs(spark, log)
    number = runs[-1] + 1 if runs else 0
    columns = ["file", "changed", "length", "path", "column", "pii_type", "n", "sign"]
    known = _log(spark, log)
    stands = known.groupBy("file", "changed", "length", "path", "column", "pii_type").agg(F.sum(F.col("n") * F.col("sign")).alias("n"), F.sum("sign").alias("s")).where("s > 0")
    back = stands.join(gone, ["file", "changed", "length"], "left_semi").withColumn("sign", F.lit(-1))
    out = back.select(*columns)
    if new:
        listed = spark.createDataFrame([tuple(r) for r in new], _FILE)
        scanned = scan_files(spark, [r.file for r in new], schema, rules, scope)
        added = listed.join(scanned, "file", "left")  # a file without rows has no counters
        out = added.withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "sign": F.lit(1)}).select(*columns).unionByName(out)
    out.write.mode("overwrite").parquet(f"{log}/run={number}")
    return [r.file for r in new]


def stored_profile(spark: SparkSession, log: str, schema, rules: Rules = DEFAULT_RULES, scope: Scope = Scope()) -> DataFrame:
    """``path``, ``column``, ``pii_type``, ``n_rows``, ``rows_scanned``, as ``profile_table`` gives them, out of the log alone."""
    key = F.concat_ws("\x01", F.coalesce("path", F.lit("")), F.coalesce("column", F.lit("")), F.coalesce("pii_type", F.lit("")))
    sums = _log(spark, log).groupBy(key.alias("k")).agg(F.sum(F.col("n") * F.col("sign")).alias("n"))
    n = sums.agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("n")).selectExpr("n", f"coalesce(n[{lit(chr(1) * 2)}], 0L) AS rows_scanned")
    _, cells = count_columns(spark.createDataFrame([], schema), rules, scope)
    stored = [(p, c, t, f"coalesce(n[concat_ws({lit(chr(1))}, {lit(p)}, {lit(c)}, coalesce({t}, ''))], 0L)") for p, c, t, _ in cells]
    return unfold_counts(n, stored)
