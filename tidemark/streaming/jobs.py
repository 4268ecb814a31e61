"""Streaming twins of the stateful jobs. Each takes a streaming (or batch) DataFrame and returns one; sinks are idempotent by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import tables


def event_id(columns: list[str]) -> F.Column:
    """An id made of the content, the same at every poll."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns]), 256)


def ingest(events: DataFrame, at: str, content: list[str], late: str = "1 hour") -> DataFrame:
    """STR1: events with `event_key`, repeats across polls dropped within the watermark."""
    keyed = events.withColumn("event_key", event_id(content)).withWatermark(at, late)
    return keyed.dropDuplicatesWithinWatermark(["event_key"]) if events.isStreaming else keyed.dropDuplicates(["event_key"])


def derived_events(polls: DataFrame, key: str, at: str, count: str) -> DataFrame:
    """STR2: one row for each unit by which a key's count rose between polls, and nothing for polls that change nothing."""
    kind = polls.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, at timestamp, n long, total long"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        out = []
        for row in pd.concat(list(frames)).sort_values([at, count]).itertuples(index=False):
            now = getattr(row, count)
            out += [(k[0], getattr(row, at), 1, last + i + 1) for i in range(max(0, int(now) - last))]
            last = max(last, int(now))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "at", "n", "total"])

    return polls.select(key, at, count).groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.NoTimeout)


def changed_only(polls: DataFrame, key: str, at: str, content: list[str]) -> DataFrame:
    """STR5: observations whose content differs from the key's one before."""
    schema = polls.schema

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for row in pd.concat(list(frames)).sort_values(at).to_dict("records"):
            now = "|".join(str(row[c]) for c in content)
            if now != last:
                kept.append(row)
                last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=schema.names)

    return polls.groupBy(key).applyInPandasWithState(step, schema, "last string", "append", GroupStateTimeout.NoTimeout)


def quote_windows(quotes: DataFrame, at: str, keys: list[str], price: str, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """STR9: count, mean and last price by key and window."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = quotes.withWatermark(at, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(price).alias("mean"), F.max_by(price, at).alias("last"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "mean", "last")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """STR8: sessions of activity with a gap limit."""
    out = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def freeze(facts: DataFrame, at: str, cutoff: str) -> DataFrame:
    """STR7: facts with `status` VISIBLE or LATE against their cutoff; late ones are kept apart, never dropped."""
    return facts.withColumn("status", F.when(F.col(at) <= F.col(cutoff), "VISIBLE").otherwise("LATE"))


def interval_join(events: DataFrame, quotes: DataFrame, key: str, event_at: str, quote_at: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """STR11: events with the quotes of their key seen within an interval before them; state is dropped by the watermarks."""
    e, q = events.withWatermark(event_at, late), quotes.withWatermark(quote_at, late)
    q = q.withColumnsRenamed({key: f"q_{key}"})
    near = (F.col(key) == F.col(f"q_{key}")) & (F.col(quote_at) <= F.col(event_at)) & (F.col(quote_at) >= F.col(event_at) - F.expr(f"interval {within}"))
    return e.join(q, near, "inner")


def ledger_sink(spark: SparkSession, path: str, key: str, content: list[str]) -> Callable[[DataFrame, int], None]:
    """STR10 and SNK3: a foreachBatch function that appends new keys once and conflicts beside; a batch that is replayed writes nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in batch.schema.fields)
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
        exists = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
        held = spark.read.schema(schema).parquet(f"{path}/ledger") if exists else spark.createDataFrame([], schema)
        marked = tables.ledger(held, batch, key, content).persist()
        try:
            marked.where("status = 'CONFLICT'").drop("status").write.mode("overwrite").parquet(f"{path}/conflicts/batch={batch_id}")
            marked.where("status = 'WRITTEN'").drop("status").write.mode("append").parquet(f"{path}/ledger")
        finally:
            marked.unpersist()

    return write
