"""Subscribers over restarts: a snapshot, then every event once."""

import json
from datetime import datetime, timezone

import pytest

from skyloom.streaming import subscriptions

SUBSCRIBER, EVENT = "subscriber string, active boolean", "event_id string, tca timestamp, risk double"


@pytest.fixture
def desk(spark, tmp_path):
    """Files of subscriptions and events put down, the stream run to its end as a new query over the same checkpoint, new messages returned."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folders = {k: str(tmp_path / k) for k in ("subscribers", "events", "out", "checkpoint")}
    seen = set()

    def run(subscribers=(), events=()):
        for name, rows, schema in (("subscribers", subscribers, SUBSCRIBER), ("events", [(e, t and datetime.fromtimestamp(t, timezone.utc), r) for e, t, r in events], EVENT)):
            spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folders[name])
        streams = [spark.readStream.schema(s).parquet(folders[n]) for n, s in (("subscribers", SUBSCRIBER), ("events", EVENT))]
        query = subscriptions.deliveries(*streams, shards=2).writeStream.format("parquet").option("checkpointLocation", folders["checkpoint"]).trigger(availableNow=True).start(folders["out"])
        query.awaitTermination(240)
        assert query.exception() is None and not query.isActive
        rows = spark.read.schema(subscriptions.TOLD).parquet(folders["out"]).select("*", "_metadata.file_path").orderBy("subscriber", "seq").collect()
        rows = [r for r in rows if r.file_path not in seen]
        seen.update(r.file_path for r in rows)
        out = {}
        for r in rows:
            out.setdefault(r.subscriber, []).append(json.loads(r.value))
        return out

    yield run
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ids(messages):
    return [e.get("event_id") for m in messages for e in (m["data"] if m["type"] == "snapshot" else [m["data"]])]


def test_snapshot_then_each_event_once(desk):
    first = desk([("a", True), (None, True)], [("e2", 20, 0.5), ("e1", 10, 0.25)])
    assert set(first) == {"a"} and first["a"][0]["type"] == "snapshot" and sorted(ids(first["a"])) == ["e1", "e2"]
    second = desk([("b", True), ("a", True)], [("e0", 5, 0.75), ("e0", 5, 0.75)])
    assert [m["type"] for m in second["a"]] == ["event", "event"] and ids(second["a"]) == ["e0", "e0"]
    assert second["b"][0]["type"] == "snapshot" and ids(second["b"])[:2] in (["e1", "e2"], ["e0", "e1"])
    assert desk() == {}
    third = desk([("a", False), ("c", None)], [])
    assert set(third) == {"c"} and ids(third["c"]) == ["e0", "e1", "e2"] and len(third["c"]) == 1
    fourth = desk([], [(None, 1, 0.1), ("e9", None, 0.1)])
    assert set(fourth) == {"b", "c"} and all(len(m) == 2 for m in fourth.values())
    fifth = desk([("a", True)], [])
    assert [m["type"] for m in fifth["a"]] == ["snapshot"] and ids(fifth["a"]) == ["e0", "e1", "e2"]


def test_snapshot_is_bounded(desk):
    n = subscriptions.MOST_ROWS
    desk([("x", True)], [(f"e{k:04d}", 1000 - k, 0.0) for k in range(n + 40)])
    (late,) = desk([("y", True)], [])["y"]
    assert [e["event_id"] for e in late["data"]] == [f"e{k:04d}" for k in range(n + 39, 39, -1)]
