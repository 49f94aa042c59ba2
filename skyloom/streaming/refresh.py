"""Refresh and screening as Structured Streaming jobs over a folder of snapshots."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skyloom.functions import tle
from skyloom.operators.catalog import age_summary, build_objects, first_of, split_records
from skyloom.operators.events import CACHE_HOURS, MOST_ROWS, score_approaches
from skyloom.operators.screening import approaches, fine_screen, pass_counts
from skyloom.sources.snapshots import parse_names
from skyloom.sources.store import merge_into


def snapshot_stream(spark: SparkSession, folder: str, per_batch: int = 1) -> DataFrame:
    """New snapshot files of a folder as they land: path, file_name, raw, grp, fetched_at."""
    files = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.tle").option("maxFilesPerTrigger", per_batch).format("text").load(folder)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    return parse_names(named)


class Screened(NamedTuple):
    objects: DataFrame
    events: DataFrame
    counts: DataFrame
    at: datetime


def screen_snapshot(snapshot: DataFrame, start: Column | None, hours: float, threshold_km: float, work: str) -> Screened | None:
    """Objects, events and counters of the newest elements in some snapshots; None with fewer than two objects.

    The screen itself is written to the folder work, from which events and
    counters are read.
    """
    at = snapshot.agg(F.max("fetched_at").alias("at")).first().at
    now = start if start is not None else F.lit(at)
    records = split_records(snapshot.select("path", "raw")).join(snapshot.select("path", "fetched_at"), "path")
    parsed = first_of(tle.parse(records, now).filter("parse_error is null"), "norad_id", F.desc("fetched_at"), "path", "rec_no")
    objects = build_objects(parsed)
    if objects.limit(2).count() < 2:
        return None
    start_s = snapshot.sparkSession.range(1).select(F.unix_micros(now) / 1e6).first()[0]
    fine_screen(parsed, None, start_s, hours, threshold_km, counts=True).write.mode("overwrite").parquet(work)
    screened = snapshot.sparkSession.read.parquet(work)
    events = score_approaches(approaches(screened), objects, now, F.lit(str(at)))
    return Screened(objects, events, pass_counts(screened), at)


def run_summary(objects: DataFrame, counts: DataFrame, at: datetime, hours: float, took_s: float, source: str, number: int) -> DataFrame:
    """The status row of one run: what was in the catalogue, how old it was, and what the screen's passes kept.

    pairs_considered are all pairs of usable objects, pairs_fine_screened those
    in band, ages are to one decimal.
    """
    n = lambda stage: F.coalesce(F.max(F.when(F.col("stage") == stage, F.col("n"))), F.lit(0))
    passes = counts.agg(n("usable").alias("usable"), n("candidates").alias("pairs_fine_screened"), n("approach").alias("events_found"), F.lit(1).alias("one"))
    ages = age_summary(objects).select("object_count", F.struct(*(F.round(c, 1).alias(c) for c in ("p50", "p90", "max"))).alias("epoch_age_hours"), F.lit(1).alias("one"))
    return ages.join(passes, "one").select(
        F.lit(number).cast("long").alias("id"),
        "object_count",
        F.lit(at).alias("last_refresh"),
        (F.lit(at) + F.make_dt_interval(hours=F.lit(CACHE_HOURS))).alias("next_refresh"),
        F.lit(source).alias("source"),
        "epoch_age_hours",
        F.lit(float(hours)).alias("screening_window_hours"),
        F.lit(round(took_s, 2)).alias("last_screen_duration_s"),
        (F.col("usable") * (F.col("usable") - 1) / 2).cast("long").alias("pairs_considered"),
        "pairs_fine_screened",
        "events_found",
    )


def refresh(
    spark: SparkSession,
    folder: str,
    out: str,
    checkpoint: str,
    hours: float = 72.0,
    threshold_km: float = 10.0,
    on_events: Callable[[DataFrame, int], None] | None = None,
    every: str | None = None,
    source: str = "celestrak-gp-active",
    per_batch: int = 1,
) -> StreamingQuery:
    """Screen each new snapshot; merge its objects and events into the tables under out, and append its status row.

    objects and conjunctions are merged by their keys, status by the batch's
    number, so a batch that runs again leaves the same tables (only the
    measured duration may differ). Without `every` ("6 hours") the stream ends
    when it has caught up.
    """

    def batch(rows: DataFrame, number: int) -> None:
        began = time.monotonic()
        done = screen_snapshot(rows, None, hours, threshold_km, f"{out}/screens/batch={number}")
        if done is None:
            return
        # merged by several passes, and sent: worked out once
        done.events.write.mode("overwrite").parquet(f"{out}/found/batch={number}")
        done.counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        events = spark.read.parquet(f"{out}/found/batch={number}")
        merge_into(f"{out}/objects", done.objects, "norad_id", "epoch")
        merge_into(f"{out}/conjunctions", events, "event_id", "screened_at")
        summary = run_summary(done.objects, spark.read.parquet(f"{out}/counts/batch={number}"), done.at, hours, time.monotonic() - began, source, number)
        merge_into(f"{out}/status", summary, "id", "last_refresh", buckets=1)
        if on_events is not None:
            on_events(events, number)

    writer = snapshot_stream(spark, folder, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def message(kind: str) -> Column:
    """A stream message: {"type": kind, "data": the row}."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.struct("*").alias("data")))


def snapshot_messages(events: DataFrame) -> DataFrame:
    """What a new subscriber gets first: up to 500 events in time order."""
    return events.orderBy("tca", "event_id").limit(MOST_ROWS).select(message("snapshot").alias("value"))


def event_messages(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New events as messages, as their files land."""
    return spark.readStream.schema(schema).parquet(folder).select(message("event").alias("value"))
