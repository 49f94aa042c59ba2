"""Subscribers of a stream of events: a snapshot first, then each new event once, with what was told kept as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from skyloom.operators.events import MOST_ROWS

#: Groups that subscribers are dealt to; each holds its own copy of the newest snapshot.
SHARDS = 8
TOLD = "subscriber string, seq long, event_id string, value string"


class Deliver(StatefulProcessor):
    """State of a shard: its subscribers with the number of messages they got, and the events of the snapshot.

    The snapshot holds the first MOST_ROWS events in order of time, so state is
    bounded by that and by the subscribers. Rows come in parts; in each,
    subscriptions go first, then events in order of time.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.told = handle.getMapState("told", "subscriber string", "seq long")
        self.kept = handle.getMapState("kept", "event_id string", "tca_s double, data string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        told = {k[0]: v[0] for k, v in self.told.iterator()}
        kept = {k[0]: (v[0], v[1]) for k, v in self.kept.iterator()}
        before, known = dict(told), dict(kept)
        for part in rows:
            out = []
            asked = part[part["subscriber"].notna()]
            for who, active in zip(asked["subscriber"], asked["active"], strict=True):
                if not active:
                    told.pop(who, None)
                elif who not in told:
                    told[who] = 1
                    first = sorted(kept, key=lambda e: (kept[e][0], e))
                    out.append((who, 1, None, json.dumps({"type": "snapshot", "data": [json.loads(kept[e][1]) for e in first]})))
            events = part[part["data"].notna()].sort_values(["tca_s", "event_id"])
            for event, tca, data in zip(events["event_id"], events["tca_s"], events["data"], strict=True):
                value = '{"type":"event","data":' + data + "}"
                for who in told:
                    told[who] += 1
                    out.append((who, told[who], event, value))
                if pd.notna(event) and pd.notna(tca):
                    kept[event] = (float(tca), data)
            if len(kept) > MOST_ROWS:
                kept = {e: kept[e] for e in sorted(kept, key=lambda e: (kept[e][0], e))[:MOST_ROWS]}
            if out:
                yield pd.DataFrame(out, columns=["subscriber", "seq", "event_id", "value"])
        for state, was, now in ((self.told, before, {k: (n,) for k, n in told.items()}), (self.kept, known, kept)):
            for k in was.keys() - now.keys():
                state.removeKey((k,))
            for k, v in now.items():
                if k not in was or v not in (was[k], (was[k],)):
                    state.updateValue((k,), v)

    def close(self) -> None:
        pass


def deliveries(subscribers: DataFrame, events: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The messages of each subscriber, numbered by seq, from streams of subscriptions and of events.

    subscribers: subscriber and active (false: leaves; who comes back gets a
    snapshot again). events: event_id, tca and more. A new subscriber first gets
    {"type": "snapshot", "data": [...]}, the first 500 of the events told so far
    in order of time, then {"type": "event", "data": {...}} for each later one.
    With a checkpoint, a restart tells nothing twice and leaves nothing out. An
    event that is published again is told again and replaces the one before in
    the snapshot; one without an id or a time is told, but not in any snapshot. A subscription without a
    name is left out. Events go to each shard, subscribers to one.
    """
    shard = F.pmod(F.xxhash64("subscriber"), F.lit(shards)).cast("int")
    asked = subscribers.filter("subscriber is not null").select(shard.alias("shard"), "subscriber", F.coalesce("active", F.lit(True)).alias("active"), F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("double").alias("tca_s"), F.lit(None).cast("string").alias("data"))
    data = F.to_json(F.struct("*"))
    told = events.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(None).cast("string").alias("subscriber"), F.lit(None).cast("boolean").alias("active"), F.col("event_id").cast("string").alias("event_id"), (F.unix_micros(F.col("tca").cast("timestamp")) / 1e6).alias("tca_s"), data.alias("data"))
    return asked.union(told).groupBy("shard").transformWithStateInPandas(statefulProcessor=Deliver(), outputStructType=TOLD, outputMode="Append", timeMode="None")
