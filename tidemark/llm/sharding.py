"""Sharding by size-tiered compaction with a versioned manifest, in DataFrame operations only.

`append` writes arrivals as small immutable shards: the rows of `SPAN` successive ids are one arrival (one that exceeds the target size is
dealt into pieces by a hash of the text). `plan` merges runs of one size tier, `FANOUT` at a time in order of arrival, until no tier of a stream (a
stretch of `STREAM` arrivals) has as many; a run of the top tier has the target size and stays. `compact` writes all planned runs in one job,
one file each, and commits. Files are never changed; a version is a Parquet table of the shards that make it up. Its pointer is written
aside and then given the version's name in one step, which fails where that name exists: so of two writers of one version one wins and the
other raises, and a writer that dies at any time leaves the versions before it as they were and the next number free. That step is a hard
link on a local file system and a rename that does not overwrite elsewhere, as atomic as the file system makes it.

Rows are found by the shard columns of their folders, joined with the version's shards; no list of files passes through the driver's code.

Ids must be numbers. Null texts have size zero and null ids form an arrival of their own; repeated rows all stay. Columns of any name are kept, except that names
starting with `__shard` are refused. An empty table commits an empty version.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ids of an arrival, arrivals of a stream, runs merged at a time.
SPAN, STREAM, FANOUT = 128, 2048, 4
#: Text bytes under which a run is of the lowest tier; each further tier is FANOUT times larger. TIERS: the top one, of 128 MiB and more.
LOWEST, TIERS = 2 << 20, 4
#: Rounds of merging that `plan` makes; FANOUT ** ROUNDS runs of a stream can become one.
ROUNDS = 6
#: Shards (some hundred bytes each) up to which a version's table is broadcast to its rows; beyond, Spark picks the join.
BROADCAST_SHARDS = 1_000_000
SHARD = ["__shard_batch", "__shard_arrival", "__shard_piece"]


def _size(text_col: str) -> Column:
    return F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, f"{path}/versions")
    return sorted(int(x.getPath().getName()) for x in fs.listStatus(p)) if fs.exists(p) else []


def commit(manifest: DataFrame, path: str, version: int, schema: T.StructType) -> None:
    """Write the manifest and its pointer aside, then name the pointer after the version; raises if that version exists."""
    spark, name = manifest.sparkSession, uuid.uuid4().hex
    manifest.write.parquet(f"{path}/manifests/{name}")
    fs, aside = _fs(spark, f"{path}/pending/{name}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(json.dumps({"manifest": name, "schema": schema.jsonValue()}).encode()))
    finally:
        out.close()
    publish(spark, f"{path}/pending/{name}", f"{path}/versions/{version:010d}")


def publish(spark: SparkSession, aside: str, name: str) -> None:
    """Give the file aside this name in one step; raises if it exists."""
    fs, to = _fs(spark, name)
    fs.mkdirs(to.getParent())
    jvm, source = spark._jvm, fs.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(aside))
    to = fs.makeQualified(to)
    if fs.getScheme() == "file":
        place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
        jvm.java.nio.file.Files.createLink(place(to), place(source))
        fs.delete(source, False)
    else:
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsc.hadoopConfiguration()).rename(source, to, options)


def _pointer(spark: SparkSession, path: str, version: int | None) -> dict:
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise ValueError(f"no version {version} below {path}")
    fs, p = _fs(spark, f"{path}/versions/{known[-1] if version is None else version:010d}")
    file = fs.open(p)
    try:
        return json.loads(bytes(file.readAllBytes()).decode())
    finally:
        file.close()


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """first, stream, tier, bytes, rows, shards (batch, arrival, piece) of each run of a version, the newest by default."""
    return spark.read.parquet(f"{path}/manifests/{_pointer(spark, path, version)['manifest']}")


def arrivals(docs: DataFrame, id_col: str, text_col: str, span: int, top: int) -> DataFrame:
    """(arrival, bytes, rows, pieces); the arrival of rows without id is -1 less than the least one can be."""
    number = F.coalesce(F.floor(F.col(id_col) / span), F.lit(-(1 << 62))).cast("long")
    sizes = docs.select(number.alias("arrival"), _size(text_col).alias("n")).groupBy("arrival").agg(F.sum("n").alias("bytes"), F.count("*").alias("rows"))
    return sizes.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("bytes") / top)).cast("long"))


def append(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, stream: int = STREAM, lowest: int = LOWEST, fanout: int = FANOUT, tiers: int = TIERS) -> int:
    """Write docs as small shards and commit the version that adds them; returns its number."""
    spark = docs.sparkSession
    if any(c.startswith("__shard") for c in docs.columns):
        raise ValueError("columns that start with __shard are reserved")
    top, batch = lowest * fanout ** (tiers - 1), f"b{uuid.uuid4().hex}"
    sizes = arrivals(docs, id_col, text_col, span, top)
    large = sizes.where("pieces > 1").select("arrival", "pieces")
    if large.limit(10_001).count() <= 10_000:  # two numbers each
        large = F.broadcast(large)
    number = F.coalesce(F.floor(F.col(id_col) / span), F.lit(-(1 << 62))).cast("long")
    rows = docs.withColumn("__shard_arrival", number).join(large.withColumnsRenamed({"arrival": "__shard_arrival", "pieces": "__shard_pieces"}), "__shard_arrival", "left")
    rows = rows.withColumn("__shard_piece", F.coalesce(F.pmod(F.xxhash64(text_col), F.col("__shard_pieces")), F.lit(0))).drop("__shard_pieces")
    _write(rows, path, batch)
    back = docs.select(number.alias("arrival"), F.xxhash64(text_col).alias("lot"), _size(text_col).alias("n")).join(sizes.select("arrival", "pieces"), "arrival")
    runs = back.groupBy("arrival", F.pmod("lot", "pieces").alias("piece")).agg(F.sum("n").alias("bytes"), F.count("*").alias("rows"))
    fresh = runs.select(
        F.struct("arrival", "piece").alias("first"), F.floor(F.col("arrival") / stream).alias("stream"), _tier(lowest, fanout, tiers).alias("tier"), "bytes", "rows",
        F.array(F.struct(F.lit(batch).alias("batch"), "arrival", "piece")).alias("shards"),
    )
    known = versions(spark, path)
    if known:
        fresh = manifest(spark, path, known[-1]).unionByName(fresh)
    commit(fresh, path, (known[-1] if known else 0) + 1, docs.schema)
    return (known[-1] if known else 0) + 1


def _write(rows: DataFrame, path: str, batch: str) -> None:
    """One file for each arrival and piece."""
    parts = rows.repartition("__shard_arrival", "__shard_piece")
    parts.write.option("compression", "zstd").partitionBy("__shard_arrival", "__shard_piece").parquet(f"{path}/data/__shard_batch={batch}")


def _tier(lowest: int, fanout: int, tiers: int) -> Column:
    out = F.lit(0)
    for k in range(tiers):
        out = out + (F.col("bytes") >= lowest * fanout**k).cast("int")
    return out


def plan(runs: DataFrame, lowest: int = LOWEST, fanout: int = FANOUT, tiers: int = TIERS, rounds: int = ROUNDS) -> DataFrame:
    """The manifest after all merges: the shards of a run that has more than one are to be merged. One shuffle by stream in all."""
    runs = runs.repartition("stream")
    order = Window.partitionBy("stream", "tier").orderBy("first")
    for _ in range(rounds):
        runs = runs.withColumn("group", F.floor((F.row_number().over(order) - 1) / fanout))
        runs = runs.withColumn("full", F.count("*").over(Window.partitionBy("stream", "tier", "group")) == fanout)
        key = F.when(F.col("full") & (F.col("tier") < tiers), F.struct(F.lit(True).alias("merged"), F.struct(F.col("tier").cast("long").alias("arrival"), F.col("group").alias("piece")).alias("of")))
        key = key.otherwise(F.struct(F.lit(False).alias("merged"), F.col("first").alias("of")))
        merged = runs.withColumn("key", key).groupBy("stream", "key").agg(
            F.min("first").alias("first"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.flatten(F.collect_list("shards")).alias("shards")
        )
        runs = merged.select("first", "stream", _tier(lowest, fanout, tiers).alias("tier"), "bytes", "rows", "shards")
    return runs


def compact(spark: SparkSession, path: str, lowest: int = LOWEST, fanout: int = FANOUT, tiers: int = TIERS, rounds: int = ROUNDS) -> int:
    """Merge what `plan` says in one job, a file for each new run, and commit the version; returns its number. The plan is written before any merge."""
    known = versions(spark, path)[-1]
    planned, batch = f"{path}/plans/{uuid.uuid4().hex}", f"b{uuid.uuid4().hex}"
    plan(manifest(spark, path, known), lowest, fanout, tiers, rounds).write.parquet(planned)
    planned = spark.read.parquet(planned)
    schema = T.StructType.fromJson(_pointer(spark, path, known)["schema"])
    merged = F.size("shards") > 1
    moves = planned.where(merged).select(F.explode("shards").alias("of"), "first")
    rows = _rows(spark, path, schema, moves.select(*_keys(), F.col("first.arrival").alias("__shard_to"), F.col("first.piece").alias("__shard_to_piece")))
    _write(rows.select(*schema.names, F.col("__shard_to").alias("__shard_arrival"), F.col("__shard_to_piece").alias("__shard_piece")), path, batch)
    own = F.array(F.struct(F.lit(batch).alias("batch"), F.col("first.arrival").alias("arrival"), F.col("first.piece").alias("piece")))
    commit(planned.withColumn("shards", F.when(merged, own).otherwise(F.col("shards"))), path, known + 1, schema)
    return known + 1


def _keys() -> list[Column]:
    return [F.col(f"of.{c.removeprefix('__shard_')}").alias(c) for c in SHARD]


def _rows(spark: SparkSession, path: str, schema: T.StructType, shards: DataFrame) -> DataFrame:
    """The rows of these shards, with the shards' columns."""
    shard_fields = [T.StructField(c, T.StringType() if c == SHARD[0] else T.LongType()) for c in SHARD]
    rows = spark.read.schema(T.StructType([*schema.fields, *shard_fields])).parquet(f"{path}/data")
    if shards.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS:
        shards = F.broadcast(shards)
    return rows.join(shards, SHARD)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version with `__shard_run` (first, tier, bytes, rows), the run that holds each."""
    schema = T.StructType.fromJson(_pointer(spark, path, version)["schema"])
    runs = manifest(spark, path, version).select(F.explode("shards").alias("of"), F.struct("first", "tier", "bytes", "rows").alias("__shard_run"))
    return _rows(spark, path, schema, runs.select(*_keys(), "__shard_run")).select(*schema.names, "__shard_run")
