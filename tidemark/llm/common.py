"""Shared helpers: the work folder every executor can reach, table materialisation, connected components."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for workers that do not find it on their own path."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(to)
    context._tidemark_shipped = True


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def own_names(f: Callable) -> Callable:
    """f of a table, whose columns that begin with two underscores bear other names meanwhile: those names are the operator's own. Names given to f follow."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **named) -> DataFrame:
        taken, other = {c.lower() for c in docs.columns}, {}
        for c in docs.columns:
            if c.startswith("__"):
                k = next(k for k in range(len(taken) + 1) if f"column_{k}" not in taken)
                other[c] = f"column_{k}"
                taken.add(other[c])
        if not other:
            return f(docs, *args, **named)
        turn = lambda x: other.get(x, x) if isinstance(x, str) else [turn(y) for y in x] if isinstance(x, list) else x
        out = f(docs.withColumnsRenamed(other), *map(turn, args), **{k: turn(v) for k, v in named.items()})
        return out.withColumnsRenamed({b: a for a, b in other.items() if b in out.columns and a not in out.columns})

    return run


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of spark.checkpoint.dir (a new local folder is set only where it is unset, and only for a local master)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    It cuts the lineage: what follows survives the loss of any executor and never repeats the work before.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, component) for undirected edges (a, b) of longs; component is the smallest node that can be reached.

    Each round takes the smallest label among a node's neighbours, then the label of that label, so long chains shrink by halves.
    Labels are written after each round; no node, label or edge comes to the driver, only the number of changed rows.
    """
    both = materialise(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges"
    )
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-0")
    for k in range(1, max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        )
        hooked = labels.join(near, "node").select("node", "label", F.least("label", "other").alias("hooked"))
        up = labels.select(F.col("node").alias("hooked"), F.col("label").alias("root"))
        new = materialise(hooked.join(up, "hooked").select("node", F.least("hooked", "root").alias("label"), F.col("label").alias("old")), f"{name}-{k}")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels.withColumnRenamed("label", "component")
