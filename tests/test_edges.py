"""Sources, sinks, contract checks, view strings and the stream."""

import json
import urllib.error
import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom import schemas
from skyloom.functions import display, scoring, tle
from skyloom.operators import catalog, events
from skyloom.sources import contract, snapshots, store
from skyloom.streaming import refresh

from tests.test_physics import ISS, VANGUARD

T0 = datetime(2026, 8, 26, 12, tzinfo=timezone.utc)


def event(i=1, **over):
    base = {
        "event_id": f"00000000-0000-0000-0000-{i:012d}", "primary": {"norad_id": 1, "name": "A"}, "secondary": {"norad_id": 2, "name": "B"}, "tca": "2026-08-26T15:51:23Z",
        "miss_distance_km": 1.0, "relative_velocity_km_s": 2.0, "radial_km": 0.1, "in_track_km": 0.2, "cross_track_km": -0.3, "combined_radius_m": 2.0, "risk_score": 0.6, "risk_tier": "AMBER",
        "confidence": 0.9, "confidence_note": "n", "max_epoch_age_hours": 3.0, "screened_at": "2026-08-26T09:00:12Z", "intra_constellation": False,
    }
    return base | over


def test_event_file_round_trip(spark, tmp_path):
    src = tmp_path / "e.json"
    src.write_text(json.dumps([event(2), event(1)]))
    rows = contract.read_events(spark, str(src))
    assert rows.columns == schemas.EVENT_SCHEMA.fieldNames() and rows.count() == 2
    out = tmp_path / "out.json"
    assert contract.export_events(rows, str(out)) == 2
    assert json.loads(out.read_text()) == [event(1), event(2)] and out.read_text().endswith("]\n")
    with pytest.raises(ValueError, match="risk_score"):
        contract.export_events(rows.withColumn("risk_score", F.lit(1.5)), str(tmp_path / "no.json"))
    assert not (tmp_path / "no.json").exists()


def test_every_violation_is_named(spark, tmp_path):
    src = tmp_path / "e.json"
    src.write_text(json.dumps([event(1), event(2, probability=0.1, risk_tier="BLUE"), event(3, primary={"norad_id": 0, "name": ""})]))
    with pytest.raises(ValueError) as e:
        contract.read_events(spark, str(src))
    text = str(e.value)
    assert all(x in text for x in ("event[1]", "probability: unknown field", "risk_tier", "event[2]", "primary.norad_id", "primary.name")) and "event[0]" not in text
    assert "probability" not in " ".join(schemas.EVENT_SCHEMA.fieldNames())


@pytest.mark.parametrize("text", ['{"event_id": 1}', "garbage", "[{", '[{"event_id": 1}', "", "null"])
def test_broken_event_files_raise(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    with pytest.raises(ValueError, match="not a JSON array"):
        contract.read_events(spark, str(tmp_path / "e.json"))


def test_types_dates_and_all_violations_are_named(spark, tmp_path):
    bad = [event(1, risk_score="0.5"), event(2, tca="yesterday"), event(3, primary=7), event(4, intra_constellation="no"), event(5, primary={"norad_id": 1.5, "name": "A"})]
    bad += [event(k, risk_tier="BLUE") for k in range(6, 1200)]
    (tmp_path / "e.json").write_text(json.dumps(bad))
    with pytest.raises(ValueError) as e:
        contract.read_events(spark, str(tmp_path / "e.json"))
    text = str(e.value)
    assert len(text.splitlines()) == len(bad)
    assert all(x in text for x in ("risk_score: not a number", "tca: not a date-time", "primary: not an object", "intra_constellation: not true or false", "primary.norad_id: not a whole number"))
    assert "required" not in text
    (tmp_path / "none.json").write_text("[]")
    assert contract.read_events(spark, str(tmp_path / "none.json")).count() == 0


def test_messages_and_refusals_are_not_cached(spark, tmp_path, caplog):
    old = tmp_path / f"active_{(T0 - timedelta(hours=9)).strftime(snapshots.STAMP)}.tle"
    old.write_text("\n".join(ISS))

    def message(url, dest):
        open(dest, "w").write("No GP data found")
        return dest

    def refused(url, dest):
        raise urllib.error.HTTPError(url, 404, "gone", None, None)

    with pytest.raises(RuntimeError, match="message"):
        snapshots.choose_snapshot(spark, str(tmp_path), "active", T0, fetcher=message)
    assert snapshots.snapshots(spark, str(tmp_path)).count() == 1
    with pytest.raises(urllib.error.HTTPError):
        snapshots.choose_snapshot(spark, str(tmp_path), "active", T0, fetcher=refused)

    def failing(url, dest):
        raise urllib.error.HTTPError(url, 503, "busy", None, None)

    with caplog.at_level("WARNING"):
        assert snapshots.choose_snapshot(spark, str(tmp_path), "active", T0, fetcher=failing)[1]
    assert "9.0 hours" in caplog.text


def test_snapshot_policy(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        snapshots.choose_snapshot(spark, str(tmp_path / "none"), "active", T0, offline=True)
    old = tmp_path / f"active_{(T0 - timedelta(hours=6)).strftime(snapshots.STAMP)}.tle"
    old.write_text("\n".join(ISS))
    (tmp_path / "misnamed.tle").write_text("x")

    def land(url, dest):
        assert "GROUP=active" in url
        open(dest, "w").write("\n".join(ISS))
        return dest

    def broken(url, dest):
        raise OSError("down")

    path, cached = snapshots.choose_snapshot(spark, str(tmp_path), "active", T0, fetcher=broken)
    assert cached and path.endswith(old.name)
    path, cached = snapshots.choose_snapshot(spark, str(tmp_path), "active", T0, fetcher=land)
    assert not cached and snapshots.snapshots(spark, str(tmp_path)).count() == 2
    assert snapshots.choose_snapshot(spark, str(tmp_path), "active", T0 + timedelta(hours=5), fetcher=broken)[1]
    objects, parsed = snapshots.load_catalog(spark, path, F.lit(T0))
    assert objects.first().norad_id == 25544 and parsed.count() == 1
    (tmp_path / "msg.tle").write_text("No GP data found")
    with pytest.raises(Exception, match="server message"):
        snapshots.load_catalog(spark, str(tmp_path / "msg.tle"), F.lit(T0))[0].count()


def test_split_errors(spark):
    whole = "\r\n".join([*ISS, "", *VANGUARD])
    df = spark.createDataFrame([("a", whole)], "path string, raw string")
    assert [r.rec_no for r in catalog.split_records(df).orderBy("rec_no").collect()] == [0, 1]
    odd = spark.createDataFrame([("b", whole + "\nX")], "path string, raw string")
    with pytest.raises(Exception, match="multiple of 3"):
        catalog.split_records(odd).count()
    assert catalog.split_records(odd, permissive=True).count() == 2


@pytest.mark.parametrize(("name", "kind"), [("COSMOS 1 DEB", "DEBRIS"), ("CZ-4C R/B", "ROCKET_BODY"), ("X (R/B)", "ROCKET_BODY"), ("DEBUT", "PAYLOAD"), ("", "UNKNOWN"), (None, "UNKNOWN"), ("iss (zarya)", "PAYLOAD")])
def test_classify(spark, name, kind):
    assert spark.createDataFrame([(name,)], "n string").select(tle.classify(F.col("n"))).first()[0] == kind


def test_confidence_points(spark):
    rows = spark.createDataFrame([(0.0, 700.0), (0.0, 450.0), (500.0, 700.0), (500.0, 450.0), (10000.0, 100.0)], "a double, p double")
    assert [round(r[0], 9) for r in rows.select(scoring.confidence(F.col("a"), F.col("p"))).collect()] == [1.0, 0.8, 0.3, 0.1, 0.1]
    tiers = spark.createDataFrame([(s,) for s in (0.70, 0.70 - 1e-9, 0.40, 0.40 - 1e-9, 0.0, 1.0)], "s double")
    assert [r[0] for r in tiers.select(scoring.risk_tier(F.col("s"))).collect()] == ["RED", "AMBER", "AMBER", "GREEN", "GREEN", "RED"]


def test_percentiles(spark):
    ages = spark.createDataFrame([(float(x),) for x in (0, 10, 20, 30, 40)], "epoch_age_hours double")
    row = catalog.age_summary(ages).first()
    assert (row.p50, row.p90, row["max"]) == (20, 36, 40)
    assert tuple(catalog.age_summary(ages.limit(0)).first()) == (0, 0.0, 0.0, 0.0)


def test_view_strings():
    view = events.parse_view("sort=risk_score&tier=red,%20green,blue&window=72&min=7&intra=1")
    assert view == {"sort": "risk_score", "dir": "desc", "tiers": ("GREEN", "RED"), "window_hours": 72.0, "min_score": 1.0, "show_intra": True}
    assert events.parse_view(events.write_view(view)) == view
    assert events.write_view(events.parse_view("")) == "" and events.is_default_filter(events.parse_view("sort=nope&window=all&min=x"))
    assert events.toggle_sort("tca", "asc", "tca") == ("tca", "desc") and events.toggle_sort("tca", "asc", "confidence") == ("confidence", "desc")
    with pytest.raises(ValueError):
        events.check_page(limit=501)


def test_labels(spark):
    got = spark.range(1).select(display.compact_count(F.lit(450419281)), display.compact_count(F.lit(12345)), display.relative_label(F.lit(-30)), display.window_label(F.lit(None).cast("int"))).first()
    assert tuple(got) == ("4.5e8", "12,345", "<1m ago", "any time")


def test_store(spark):
    objects = spark.createDataFrame([(1, "A")], "norad_id int, name string")
    found = spark.createDataFrame([(1, 2)], "primary_norad_id int, secondary_norad_id int")
    with pytest.raises(ValueError, match=r"\[2\]"):
        store.check_references(found, objects)
    assert store.migrate_events(found).first().intra_constellation is False


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "active_20080920T130000Z.tle").write_text("\n".join([*ISS, *VANGUARD]) + "\n")
    seen = []
    out = str(tmp_path / "out")
    tables = lambda: {t: sorted(map(str, (r.asDict() for r in store.read_table(spark, f"{out}/{t}", k).drop("last_screen_duration_s").collect()))) for t, k in (("objects", schemas.CATALOG_SCHEMA), ("conjunctions", schemas.EVENT_SCHEMA), ("status", schemas.STATUS_SCHEMA))}
    for attempt in ("ck", "again"):  # the second run replays the same batch from a new checkpoint
        query = refresh.refresh(spark, str(folder), out, str(tmp_path / attempt), hours=1, on_events=lambda df, n: seen.append(df.count()))
        query.awaitTermination(120)
        assert query.exception() is None
        first = tables() if attempt == "ck" else first
    assert len(seen) == 2 and tables() == first
    assert spark.read.parquet(f"{out}/objects").count() == 2
    counts = spark.read.parquet(f"{out}/counts")
    assert counts.filter("stage = 'candidates'").count() == 1
    status = spark.read.parquet(f"{out}/status").collect()
    assert len(status) == 1 and status[0].object_count == 2 and status[0].pairs_considered == 1 and status[0].epoch_age_hours["max"] > 24 and status[0].next_refresh > status[0].last_refresh
    # a later snapshot of one object replaces it, and adds a status row
    (folder / "active_20080920T150000Z.tle").write_text("\n".join(["ISS (RENAMED)", *ISS[1:], *VANGUARD]) + "\n")
    refresh.refresh(spark, str(folder), out, str(tmp_path / "ck"), hours=1).awaitTermination(120)
    assert {r.name for r in spark.read.parquet(f"{out}/objects").collect()} == {"ISS (RENAMED)", VANGUARD[0]} and spark.read.parquet(f"{out}/status").count() == 2
    message = refresh.snapshot_messages(store.read_table(spark, f"{out}/conjunctions", schemas.EVENT_SCHEMA)).schema
    assert message.fieldNames() == ["value"] and os.path.isdir(tmp_path / "ck")


def test_newest_elements_of_several_snapshots(spark, tmp_path):
    rows = [(f"/x/a_{k}.tle", "\n".join([f"ISS {k}", *ISS[1:], *VANGUARD]), T0.replace(hour=h)) for k, h in ((1, 5), (2, 9), (3, 7))]
    done = refresh.screen_snapshot(spark.createDataFrame(rows, "path string, raw string, fetched_at timestamp"), None, 1.0, 10.0, str(tmp_path / "work"))
    assert {r.name for r in done.objects.collect()} == {"ISS 2", VANGUARD[0]}


def test_merge_touches_only_its_folders(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, v string, at long"
    store.merge_into(path, spark.createDataFrame([(k, "old", 0) for k in range(200)], schema), "id", "at", 16)
    written = lambda: {f.path: f.modificationTime for f in spark.read.format("binaryFile").load(f"{path}/*/*.parquet").select("path", "modificationTime").collect()}
    before = written()
    for _ in range(2):
        store.merge_into(path, spark.createDataFrame([(7, "first", 1), (7, "last", 2), (900, "new", 1)], schema), "id", "at", 16)
        got = {r.id: r.v for r in store.read_table(spark, path, schema).collect()}
        assert len(got) == 201 and got[7] == "last" and got[900] == "new" and all(v == "old" for k, v in got.items() if k not in (7, 900))
    assert len(set(before) & set(written())) >= 13
    store.merge_into(path, spark.createDataFrame([], schema), "id", "at", 16)
    assert store.read_table(spark, str(tmp_path / "none"), schema).count() == 0


def test_quantiles(spark):
    rng = np.random.default_rng(8)
    for values in ([5.0], [1.0, 2.0], [3.0] * 50 + [4.0], (1000 * rng.random(777)).tolist(), np.round(9 * rng.random(500)).tolist(), [-7.5, 2.0, 2.0, 1e9]):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        got = catalog.quantiles(df, "v", {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}).first()
        assert np.allclose(tuple(got), np.quantile(values, [0.5, 0.9, 0, 1]), rtol=1e-12)
    assert tuple(catalog.quantiles(df.limit(0), "v", {"a": 0.5}).first()) == (None,)
    assert tuple(catalog.age_summary(df.limit(0), "v").first()) == (0, 0.0, 0.0, 0.0)
