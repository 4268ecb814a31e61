"""File scans with validation, manifests, and versioned publishing."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.tables import table_hash


def texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: path, sha256, size and text of each file; UTF-8, else Latin-1. Spark passes over files of no bytes: `manifest` has them as MISSING."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def file_report(files: DataFrame, required: list[str]) -> DataFrame:
    """SRC2: one row a file with its columns, rows and the first reason to refuse it."""
    lines = F.filter(F.split(F.regexp_replace("text", "\r", ""), "\n"), lambda x: F.trim(x) != "")
    f = files.withColumn("lines", lines).withColumn("columns", F.split(F.get("lines", 0), ","))
    width = F.size("columns")
    widths = F.transform(F.slice("lines", 2, F.greatest(F.lit(0), F.size("lines") - 1)), lambda x: F.size(F.split(x, ",")))
    reason = (
        F.when(F.size("lines") == 0, "empty").when(F.lower(F.trim("text")).startswith("<"), "html_page")
        .when(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), "columns")) > 0, "missing_columns").when(F.size("lines") == 1, "header_only")
        .when(F.exists(widths, lambda n: n < width), "truncated_row").when(F.exists(widths, lambda n: n > width), "malformed_row")
    )
    return f.select("path", "sha256", "size", F.sha2(F.array_join("columns", ","), 256).alias("schema_hash"), F.greatest(F.lit(0), F.size("lines") - 1).alias("rows"), reason.alias("reason"))


def manifest(report: DataFrame, expected: DataFrame) -> DataFrame:
    """SRC3: the report joined with expected checksums (name, sha256): OK, CHANGED, UNEXPECTED or MISSING."""
    r = report.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    e = expected.select("name", F.col("sha256").alias("expected"))
    status = F.when(F.col("path").isNull(), "MISSING").when(F.col("expected").isNull(), "UNEXPECTED").when(F.col("expected") != F.col("sha256"), "CHANGED").otherwise("OK")
    return r.join(e, "name", "full_outer").select("name", "sha256", "expected", "rows", "reason", status.alias("status"))


def csv_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of the files (header first) as the named columns, by the header's own order; absent ones are null."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n")).alias("n", "line"), F.split(F.regexp_extract("text", r"^([^\r\n]*)", 1), ",").alias("header"))
    cells = F.map_from_arrays("header", F.slice(F.concat(F.split("line", ","), F.array_repeat(F.lit(""), F.size("header"))), 1, F.size("header")))
    rows = lines.where((F.col("n") > 0) & (F.trim("line") != "")).withColumn("cells", cells)
    return rows.select("path", "n", *[F.try_element_at("cells", F.lit(c)).alias(c) for c in columns])


def publish(df: DataFrame, path: str, partition_by: list[str], sort_by: list[str]) -> None:
    """SNK1: typed Parquet, sorted within files, one folder a partition."""
    out = df.repartition(*partition_by).sortWithinPartitions(*partition_by, *sort_by) if partition_by else df.sortWithinPartitions(*sort_by)
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _path(spark: SparkSession, name: str):
    """(file system, path) of a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def publish_version(df: DataFrame, path: str, version: str) -> str:
    """SNK2: write aside, compare content hashes, refuse other content under a known version, move the pointer last.

    A version appears by one rename that overwrites nothing, so of two writers one wins and the other compares. The pointer is a series of empty files whose names
    hold a number and the version: a new one is made in one step and the greatest counts, so readers always find the old version or the new one.
    """
    spark = df.sparkSession
    jvm, target = spark._jvm, f"{path}/version={version}"
    aside = f"{path}/.aside-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    files, to = _path(spark, target)
    source = files.makeQualified(_path(spark, aside)[1])
    try:
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration()).rename(source, files.makeQualified(to), options)
    except Py4JJavaError:
        if not files.exists(to):
            raise
        same = table_hash(spark.read.parquet(target)) == table_hash(spark.read.parquet(aside))
        files.delete(source, True)
        if not same:
            raise ValueError(f"version {version} exists with other content") from None
    known = pointers(spark, path)
    if not known or known[-1][1] != version:
        files.createNewFile(_path(spark, f"{path}/pointer/{(known[-1][0] if known else 0) + 1:012d}.{version}")[1])
    return version


def pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers so far, the one that counts last."""
    files, folder = _path(spark, f"{path}/pointer")
    names = sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []
    return [(int(n.split(".", 1)[0]), n.split(".", 1)[1]) for n in names]


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/version={pointers(spark, path)[-1][1]}")
