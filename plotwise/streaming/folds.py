"""State machines over out-of-order events, with arbitrary keyed state.

An event that comes late is put where it belongs, so the result is that of all events in order, whatever order files come in. The state of a key
holds what a later event could still change and no more: of a fold that something ends (another stage, a down vote), the events since.
Each state is one JSON text: one read and one write a key and batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plotwise.operators.stages import STAGES, default_step
from plotwise.scratch import scratch_path
from plotwise.streaming.jobs import run_batches
from plotwise.streaming.tables import BatchTable, KeyedTable

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def add_stage_events(state: dict, events: list[list]) -> dict:
    """``state`` after further ``events`` [at, event_id, stage or None, typed step or None, researcher], in any order.

    ``lasts`` has the last time of each stage, ``first`` the first event. The current stage is the last one; its run began with its first event after
    ``end``, the last event of any other stage. That time only moves on, so events up to it are never needed again.
    """
    lasts, first, kept = dict(state.get("lasts", {})), state.get("first"), list(state.get("kept", []))
    for at, event_id, stage, step, researcher in events:
        order = [at, event_id]
        if first is None or order < first[:2]:
            first = [*order, researcher]
        if stage in STAGES:
            lasts[stage] = max(lasts.get(stage, order), order)
        if stage in STAGES or step is not None:
            kept.append([at, event_id, stage if stage in STAGES else None, step])
    now = max(lasts, key=lambda s: lasts[s]) if lasts else STAGES[0]
    end = max((t for s, t in lasts.items() if s != now), default=None)
    kept = sorted((e for e in kept if end is None or e[:2] > end), key=lambda e: e[:2])
    return {"lasts": lasts, "first": first, "kept": kept, "stage": now, "end": end}


def stage_of(state: dict) -> tuple[str, str | None, str | None]:
    """(stage, typed step of its run, researcher)."""
    now, kept = state["stage"], state["kept"]
    starts = [e[:2] for e in kept if e[2] == now]
    if now == STAGES[0] and state["end"] is None:
        typed = [e[3] for e in kept if e[3] is not None]
    else:
        typed = [e[3] for e in kept if e[3] is not None and e[:2] >= starts[0]]
    return now, typed[-1] if typed else None, state["first"][2] if state["first"] else None


def add_votes(state: dict, events: list[list]) -> dict:
    """``state`` after further ``events`` [at, event_id, name]: the last event, the last down and the ups and oks after it."""
    last, down, ups = state.get("last"), state.get("down"), list(state.get("ups", []))
    for at, event_id, name in events:
        if last is None or [at, event_id] > last[:2]:
            last = [at, event_id, name]
        if name == "down" and (down is None or [at, event_id] > down):
            down = [at, event_id]
        if name in ("up", "ok"):
            ups.append([at, event_id])
    return {"last": last, "down": down, "ups": sorted(u for u in ups if down is None or u > down)}


class _Fold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def _add(self, rows: Iterator[pd.DataFrame], add, columns: list[str]) -> dict:
        events = [[None if x is None or x != x else x for x in r] for part in rows for r in part[columns].astype(object).values.tolist()]
        now = add(json.loads(self.state.get()[0]) if self.state.exists() else {}, events)
        self.state.update((json.dumps(now),))
        return now

    def close(self) -> None:
        pass


class StageFold(_Fold):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stage, typed, researcher = stage_of(self._add(rows, add_stage_events, ["at", "event_id", "stage", "next_step", "researcher"]))
        yield pd.DataFrame({"listing_id": [key[0]], "stage": [stage], "typed": [typed], "researcher": [researcher]})


class VoteFold(_Fold):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self._add(rows, add_votes, ["at", "event_id", "event"])
        yield pd.DataFrame({"researcher": [key[0]], "listing_id": [key[1]], "last": [now["last"][2]], "since": pd.array([now["ups"][0][0] if now["ups"] else None], "Int64")})


def _fold(events: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, root: str, mode: str = "None") -> KeyedTable:
    """The fold of a stream by key, as a table of the last row of each key under ``root``; with the same root a later run goes on where this one ends."""
    spark = events.sparkSession
    table = KeyedTable(spark, f"{root}/rows", schema, [c.split()[0] for c in schema.split(", ")][: len(keys)])
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        made = events.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", mode)
        made.writeStream.foreachBatch(table.write).outputMode("update").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return table


def _micros(at: str):
    """A time as a number; null times come first."""
    return F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62)))


def stage_stream(events: DataFrame, root: str | None = None) -> DataFrame:
    """ST6: ``fold_stages`` over a stream of (listing_id, researcher, stage, next_step, at, event_id) in any order.

    ``root`` is the job's folder in the shared store: its state, progress and rows. A run with the root of an earlier one, stopped or failed, goes on
    from there; without a root it starts anew.
    """
    rows = events.select(F.col("listing_id").cast("string").alias("listing_id"), "researcher", "stage", "next_step", _micros("at").alias("at"), F.col("event_id").cast("long").alias("event_id"))
    table = _fold(rows, ["listing_id"], StageFold(), "listing_id string, stage string, typed string, researcher string", root or scratch_path(events.sparkSession, "stages"))
    kind = events.schema["listing_id"].dataType
    return table.state().select(F.col("listing_id").cast(kind).alias("listing_id"), "stage", F.coalesce("typed", default_step(F.col("stage"), F.col("researcher"))).alias("next_step"), (F.col("stage") != "dropped").alias("active"))


def vote_stream(events: DataFrame, root: str | None = None) -> DataFrame:
    """ST4: ``fold_votes`` over a stream of (researcher, listing_id, event, at, event_id) in any order; ``root`` as in :func:`stage_stream`. An event
    that was read counts once, also if its batch is run again: state and progress are committed together."""
    rows = events.select("researcher", "listing_id", "event", _micros("at").alias("at"), F.col("event_id").cast("long").alias("event_id"))
    table = _fold(rows, ["researcher", "listing_id"], VoteFold(), "researcher string, listing_id string, last string, since long", root or scratch_path(events.sparkSession, "votes"))
    vote = F.when(F.col("last").isin("up", "ok"), 1).when(F.col("last") == "down", -1)
    since = F.when(F.col("since") > -(1 << 62), F.timestamp_micros("since"))
    return table.state().select("researcher", "listing_id", vote.alias("vote"), (F.col("last") == "down").alias("rejected"), (F.col("last") == "ok").alias("confirmed"), since.alias("pipeline_since"))


def expiry_stream(seen: DataFrame, days: int, root: str | None = None) -> DataFrame:
    """ST8: (id) of what was seen within ``days`` of the newest time in the stream (id, last_seen), in any order.

    A batch adds the last time of each of its own ids, and the greatest counts when they are read, so a batch costs what it adds and ids are compared
    in the JVM. ``root`` as in :func:`stage_stream`.
    """
    spark, root = seen.sparkSession, root or scratch_path(seen.sparkSession, "expiry")
    kind = seen.schema["id"].dataType.simpleString()
    table = BatchTable(spark, f"{root}/seen", f"id {kind}, at timestamp")
    last = F.max("at").alias("at")
    run_batches(seen.where(F.col("last_seen").isNotNull()).select("id", F.col("last_seen").cast("timestamp").alias("at")), lambda batch, n: table.write(batch.groupBy("id").agg(last), n), root)
    rows = table.read()
    newest = rows.agg(F.max("at").alias("newest"))
    return rows.groupBy("id").agg(last).crossJoin(F.broadcast(newest)).where(F.expr(f"at >= newest - interval {days} days")).select("id")
