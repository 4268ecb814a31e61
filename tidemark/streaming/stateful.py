"""Keyed state with event-time timers: stages that freeze when their cutoff passes, states that tell changes only, prices that make triples.

All run as `transformWithState` over pandas batches: state lives in the state store (RocksDB) under its key, frames come in bounded batches, and
rows are handled frame by frame. Stages and changed states deal their keys to lots by hash: a lot has one state, one timer and one call, and its keys are worked on together,
as a call for each key costs far more than its few rows. `state_store` names the provider that such queries need.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _ms(x) -> int:
    return int(pd.Timestamp(x).value // 1_000_000)


#: Lots that keys are dealt to; what one call holds is a lot's share of the keys that are open.
LOTS = 4096


def _lot(key: str, lots: int) -> Column:
    """The lot of a key; the rows without one are a lot of their own."""
    return F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(lots))).cast("int").alias("lot")


def _packed(frame: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    frame = pa.ipc.open_stream(bytes(data)).read_all().to_pandas()
    return frame.astype({"event_ms": "Int64"}) if "event_ms" in frame else frame


def _codes(held: pd.Series, new: pd.Series) -> tuple[np.ndarray, int]:
    """Numbers from 0 of the keys of both, equal for equal keys (null too), and how many there are."""
    both = new if not len(held) else held if not len(new) else pd.concat([held, new], ignore_index=True)
    codes, kinds = pd.factorize(both, use_na_sentinel=False)
    return codes, len(kinds)


def _all_ms(x: pd.Series) -> np.ndarray:
    return x.to_numpy("datetime64[ns]").astype("i8") // 1_000_000


class StageFreeze(StatefulProcessor):
    """Facts of a lot's keys until each stage's cutoff; a stage's row is told once the watermark has passed it, facts or not. One timer a lot, at the next cutoff of any of its keys."""

    def __init__(self, stages: dict[str, int]):
        self.stages = sorted(stages.items(), key=lambda s: -s[1])  # the earliest cutoff first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "plan binary, facts binary")

    def load(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        if self.held.exists():
            return tuple(_unpacked(x) for x in self.held.get())
        return pd.DataFrame({"key": [], "event_ms": [], "told": [], "moved": []}), pd.DataFrame({"key": [], "at": [], "value": []})

    def save(self, plan: pd.DataFrame, facts: pd.DataFrame) -> None:
        """Facts of keys whose stages are all told change nothing any more and go."""
        done = plan["told"].to_numpy() == len(self.stages)
        if done.any() and len(facts):
            codes, _ = _codes(plan["key"], facts["key"])
            finished = np.zeros(len(plan) + len(facts), bool)
            finished[codes[: len(plan)][done]] = True
            facts = facts[~finished[codes[len(plan) :]]]
        self.held.update((_packed(plan), _packed(facts)))

    def cutoffs(self, plan: pd.DataFrame) -> np.ndarray:
        """A row for each key with an event, a column for each stage."""
        return plan["event_ms"].to_numpy("i8")[:, None] - np.array([m for _, m in self.stages]) * 60_000

    def wake(self, plan: pd.DataFrame) -> None:
        """The lot's only timer, at the earliest cutoff that is still to be told."""
        due = plan[plan["event_ms"].notna() & (plan["told"] < len(self.stages))]
        told = due["told"].to_numpy("i8")
        at = {int(self.cutoffs(due)[np.arange(len(due)), told].min())} if len(due) else set()
        have = {int(t[0] if isinstance(t, tuple) else t) for t in self.handle.listTimers()}
        for t in have - at:
            self.handle.deleteTimer(t)
        for t in at - have:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        plan, facts = self.load()
        new = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable")
        codes, n = _codes(plan["key"], new["key"])
        old, own = codes[: len(plan)], codes[len(plan) :]
        keys = np.empty(n, object if key[0] < 0 else new["key"].dtype)
        keys[own], keys[old] = new["key"], plan["key"]
        event, told, moved = np.full(n, np.nan), np.zeros(n, "i8"), np.zeros(n, "i8")
        event[old], told[old], moved[old] = plan["event_ms"], plan["told"], plan["moved"]
        stated = new["event_at"].notna().to_numpy()
        now = np.full(n, np.nan)
        now[own[stated]] = _all_ms(new["event_at"][stated])  # the last of a key stands
        moved += ~np.isnan(event) & ~np.isnan(now) & (event != now)
        event = np.where(np.isnan(now), event, now)
        fact = (new["at"].notna() & new["value"].notna()).to_numpy()
        more = pd.DataFrame({"key": new["key"][fact], "at": _all_ms(new["at"][fact]), "value": new["value"][fact].astype(float)})
        plan = pd.DataFrame({"key": keys, "event_ms": pd.array([None if np.isnan(e) else int(e) for e in event], "Int64"), "told": told, "moved": moved})
        self.save(plan, more if not len(facts) else pd.concat([facts, more], ignore_index=True))
        self.wake(plan)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        plan, facts = self.load()
        now = int(timerValues.getCurrentWatermarkInMs())
        known = plan["event_ms"].notna().to_numpy()
        upto, told = np.zeros(len(plan), "i8"), plan["told"].to_numpy("i8")
        cutoffs = np.zeros((len(plan), len(self.stages)), "i8")
        cutoffs[known] = self.cutoffs(plan[known])
        upto[known] = (cutoffs[known] <= now).sum(axis=1)
        which, stage = np.nonzero((np.arange(len(self.stages)) >= told[:, None]) & (np.arange(len(self.stages)) < upto[:, None]))
        if len(which):
            yield self.rows(key, plan, facts, which, stage, cutoffs[which, stage], now)
            plan["told"] = np.maximum(told, upto)
            self.save(plan, facts)
        self.wake(plan)

    def rows(self, key, plan: pd.DataFrame, facts: pd.DataFrame, which: np.ndarray, stage: np.ndarray, cutoff: np.ndarray, now: int) -> pd.DataFrame:
        """The told rows: keys by their place in the plan, each with the newest of the facts known by the cutoff."""
        codes, n = _codes(plan["key"], facts["key"])
        own, of = codes[: len(plan)], codes[len(plan) :]
        at, value = facts["at"].to_numpy("i8"), facts["value"].to_numpy(float)
        order = np.lexsort((value, at, of))
        of, at, value = of[order], at[order], value[order]
        begin, low = np.searchsorted(of, own[which]), at.min() if len(at) else 0
        width = (at.max() - low if len(at) else 0) + 2  # keys one after the other on one line of times
        upto = np.searchsorted(of * width + (at - low + 1), own[which] * width + np.clip(cutoff - low + 1, 0, width - 1), "right")
        count = upto - begin
        last = np.maximum(upto - 1, 0)
        none = count == 0
        if not len(at):
            at, value = np.zeros(1, "i8"), np.zeros(1)
        fact_at = pd.Series(pd.to_datetime(at[last], unit="ms")).mask(none)
        event = plan["event_ms"].to_numpy("i8", na_value=0)[which]
        return pd.DataFrame({
            "key": None if key[0] < 0 else plan["key"].to_numpy()[which], "stage": np.array([s for s, _ in self.stages], object)[stage], "cutoff": pd.to_datetime(cutoff, unit="ms"),
            "status": np.where(none, "EMPTY", "FROZEN"), "value": np.where(none, np.nan, value[last]), "fact_at": fact_at,
            "facts": count, "missed": now >= event, "late_minutes": (now - cutoff) // 60_000, "moved": plan["moved"].to_numpy("i8")[which],
        })

    def close(self) -> None:
        pass


def freeze_stages(facts: DataFrame, key: str, at: str, event_at: str, value: str, stages: dict[str, int], late: str = "1 hour", lots: int = LOTS) -> DataFrame:
    """STR6: one row a key and stage, told when the watermark passes the stage's cutoff (minutes before the event).

    key, stage, cutoff, status (FROZEN, or EMPTY where no fact was known), value and fact_at of the newest fact known by then, facts (how many), missed (the event had
    begun when the row was told), late_minutes, moved (in how many batches the event's time changed; stages not yet told follow it). Facts after a cutoff never enter its row, nor do those without time.
    """
    kind = facts.schema[key].dataType.simpleString()
    rows = facts.select(_lot(key, lots), F.col(key).alias("key"), F.col(at).alias("at"), F.col(event_at).alias("event_at"), F.col(value).cast("double").alias("value")).withWatermark("at", late)
    schema = f"key {kind}, stage string, cutoff timestamp, status string, value double, fact_at timestamp, facts long, missed boolean, late_minutes long, moved long"
    return rows.groupBy("lot").transformWithStateInPandas(StageFreeze(stages), schema, "Append", "EventTime")


class ChangedStates(StatefulProcessor):
    """The last hash of each of a lot's keys; a poll is told when status, count or bucket of minutes differ from those of the one before."""

    def __init__(self, bucket: int, stale: int, pause: int):
        self.bucket, self.stale, self.pause = bucket, stale, pause

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = _unpacked(self.last.get()[0]) if self.last.exists() else pd.DataFrame({"key": [], "hash": [], "events": [], "minute": []})
        new = pd.concat(list(rows), ignore_index=True)
        codes, n = _codes(held["key"], new["key"])
        old, own = codes[: len(held)], codes[len(held) :]
        order = np.lexsort((new["total"].to_numpy(float, na_value=np.nan), new["at"].to_numpy("i8"), own))
        new, own = new.iloc[order].reset_index(drop=True), own[order]
        first = np.r_[True, own[1:] != own[:-1]]
        hashes, events, newest = np.full(n, "", object), np.zeros(n, "i8"), np.full(n, np.nan)
        hashes[old], events[old], newest[old] = held["hash"], held["events"], held["minute"].to_numpy(float, na_value=np.nan)
        begin = np.flatnonzero(first)
        polls = events[own] + np.arange(len(own)) - np.repeat(begin, np.diff(np.r_[begin, len(own)])) + 1
        seen = pd.Series(np.fmax(new["event_minute"].to_numpy(float, na_value=np.nan), np.where(first, newest[own], np.nan))).groupby(own).cummax().groupby(own).ffill().to_numpy()
        minute, source = self.minutes(new, seen)
        state, kinds = pd.factorize(pd.MultiIndex.from_arrays([new["status"], new["total"], np.where(np.isnan(minute), -1, minute // self.bucket)]))
        told = np.array([hashlib.sha256(json.dumps([None if pd.isna(s) else s, None if pd.isna(t) else int(t), None if b < 0 else int(b)]).encode()).hexdigest() for s, t, b in kinds], object)[state]
        before = np.r_[[""], told[:-1]].astype(object)
        before[first] = hashes[own[first]]
        playing = (new["status"] == "IN_PLAY").to_numpy()
        forecastable = playing & ~np.isnan(minute) & ~((source == "clock") & (minute > self.stale))
        out = pd.DataFrame({
            "key": None if key[0] < 0 else new["key"], "at": new["at"], "status": new["status"], "total": new["total"], "minute": pd.array(np.where(np.isnan(minute), 0, minute).astype("i4"), "Int32"),
            "minute_source": source, "state_hash": told, "polls": polls, "forecastable": forecastable,
        })
        out["minute"] = out["minute"].mask(np.isnan(minute))
        ends = np.r_[begin[1:] - 1, len(own) - 1]
        keys = np.empty(n, object if key[0] < 0 else new["key"].dtype)
        keys[old], keys[own] = held["key"], new["key"]
        hashes[own[ends]], events[own[ends]], newest[own[ends]] = told[ends], polls[ends], seen[ends]
        self.last.update((_packed(pd.DataFrame({"key": keys, "hash": hashes, "events": events, "minute": newest})),))
        yield out[told != before]

    def minutes(self, polls: pd.DataFrame, newest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The reported minute, else (in play only) the last event's if the clock is behind it, else the clock's with the pause taken out; and which of them."""
        gone = (polls["at"] - polls["start_at"]).dt.total_seconds().to_numpy() / 60
        clock = np.where(gone <= 45, np.floor(gone), np.where(gone <= 45 + self.pause, 45, np.minimum(np.floor(gone - self.pause), 120)))
        timed = (polls["status"] == "IN_PLAY").to_numpy() & (gone >= 0)
        reported = polls["reported"].to_numpy(float, na_value=np.nan)
        later = newest > clock
        minute = np.where(~np.isnan(reported), reported, np.where(timed, np.where(later, newest, clock), np.nan))
        source = np.where(~np.isnan(reported), "reported", np.where(timed, np.where(later, "last_event", "clock"), "")).astype(object)
        source[source == ""] = None
        return minute, source

    def close(self) -> None:
        pass


def changed_states(polls: DataFrame, key: str, bucket: int = 5, stale: int = 100, pause: int = 15, lots: int = LOTS) -> DataFrame:
    """STR3: polls whose state hash (status, total, bucket of minutes) differs from that of the key's poll before.

    polls: key, at, start_at, status, total, reported (minute or null), event_minute (or null). Gives key, at, status, total, minute, minute_source (reported, last_event or
    clock), state_hash, polls (seen so far) and forecastable: in play with a minute, and not past minute `stale` by the clock alone. A poll without start has no clock.
    """
    kind = polls.schema[key].dataType.simpleString()
    rows = polls.select(_lot(key, lots), F.col(key).alias("key"), "at", "start_at", "status", "total", "reported", "event_minute")
    schema = f"key {kind}, at timestamp, status string, total long, minute int, minute_source string, state_hash string, polls long, forecastable boolean"
    return rows.groupBy("lot").transformWithStateInPandas(ChangedStates(bucket, stale, pause), schema, "Append", "None")


class Triples(StatefulProcessor):
    """The newest price of each outcome of a contest and maker; a complete triple is told at every price that leaves it within the bounds."""

    def __init__(self, spread_ms: int, stale_ms: int):
        self.spread_ms, self.stale_ms = spread_ms, stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getMapState("newest", "outcome int", "stated long, seen long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: tuple(v) for k, v in self.newest.iterator()}
        for frame in rows:
            out = []
            for r in frame.sort_values(["seen_at", "stated_at", "outcome", "price"]).itertuples(index=False):
                stated, seen = _ms(r.stated_at), _ms(r.seen_at)
                old = held.get(int(r.outcome))
                if old is None or stated >= old[0]:
                    held[int(r.outcome)] = (stated, seen, float(r.price))
                if len(held) == 3:
                    times = [v[0] for v in held.values()]
                    if max(times) - min(times) <= self.spread_ms and seen - min(times) <= self.stale_ms:
                        out.append((key[0], key[1], r.seen_at, *(held[k][2] for k in range(3)), (seen - min(times)) / 60_000))
            yield pd.DataFrame(out, columns=["contest", "maker", "at", "a", "b", "c", "age_minutes"])
        for k, v in held.items():
            self.newest.updateValue((k,), v)

    def close(self) -> None:
        pass


def quote_triples(quotes: DataFrame, late: str = "1 hour", spread_minutes: int = 10, stale_hours: int = 24) -> DataFrame:
    """STR4: complete price triples by contest and maker: every outcome's newest price, stated within `spread_minutes` of each other, none older than `stale_hours` when seen.

    quotes: contest, maker, outcome (0 to 2), price, stated_at and seen_at; prices not above 1 are left out.
    """
    rows = quotes.where("price > 1 and outcome between 0 and 2").withWatermark("seen_at", late)
    kinds = [rows.schema[c].dataType.simpleString() for c in ("contest", "maker")]
    schema = f"contest {kinds[0]}, maker {kinds[1]}, at timestamp, a double, b double, c double, age_minutes double"
    return rows.groupBy("contest", "maker").transformWithStateInPandas(Triples(spread_minutes * 60_000, stale_hours * 3_600_000), schema, "Append", "EventTime", eventTimeColumnName="at")


def consensus_windows(triples: DataFrame, width: str = "10 minutes", slide: str | None = None, least_makers: int = 2) -> DataFrame:
    """AGG12 over STR4: each maker's last triple of a window as probabilities without margin, then mean and dispersion over the makers; a second stateful step behind the first."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    margin = 1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c")
    last = triples.groupBy(w.alias("w"), "contest", "maker").agg(F.max_by(F.struct(*[(1 / F.col(x) / margin).alias(x) for x in "abc"], "age_minutes"), F.struct("at", "a", "b", "c")).alias("t"))
    mean = lambda c: F.avg(f"t.{c}").alias(f"p_{c}")
    spread: Column = (F.stddev_pop("t.a") + F.stddev_pop("t.b") + F.stddev_pop("t.c")) / 3
    out = last.groupBy("w", "contest").agg(F.count("*").alias("makers"), mean("a"), mean("b"), mean("c"), spread.alias("dispersion"), F.avg("t.age_minutes").alias("age_minutes"))
    return out.where(F.col("makers") >= least_makers).select("contest", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "makers", "p_a", "p_b", "p_c", "dispersion", "age_minutes")
