"""Conjunction events: scoring, listing, filtering, sorting, lookups, status and time series."""

from __future__ import annotations

from datetime import datetime
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.constants import CACHE_HOURS, EARTH_RADIUS_KM
from skyloom.functions import scoring, tle
from skyloom.functions.display import iso_utc
from skyloom.operators.catalog import age_summary
from skyloom.schemas import RISK_TIERS

MOST_ROWS = 500


def score_approaches(approaches: DataFrame, objects: DataFrame, screened_at: Column, run: Column | None = None, age_basis: str = "screening") -> DataFrame:
    """Events of approaches joined with both objects of the catalogue.

    age_basis 'screening' takes ages as of screened_at, 'fetch' the catalogue's own.
    """
    if age_basis not in ("screening", "fetch"):
        raise ValueError("age_basis is 'screening' or 'fetch'")
    age = F.col("epoch_age_hours") if age_basis == "fetch" else tle.age_hours(F.col("epoch"), screened_at)
    side = objects.select("norad_id", "name", "object_type", "radius_m", "perigee_km", age.alias("age"))
    a, b = (side.select(*(F.col(c).alias(f"{p}_{c}") for c in side.columns)) for p in ("a", "b"))
    rows = approaches.join(a, F.col("primary_norad_id") == F.col("a_norad_id")).join(b, F.col("secondary_norad_id") == F.col("b_norad_id"))
    rows = rows.withColumns(
        {
            "combined_radius_m": F.col("a_radius_m") + F.col("b_radius_m"),
            "max_epoch_age_hours": F.greatest("a_age", "b_age"),
            "min_perigee_km": F.least("a_perigee_km", "b_perigee_km"),
            "screened_at": screened_at,
        }
    )
    rows = rows.withColumn("risk_score", scoring.risk_score(F.col("miss_distance_km"), F.col("relative_velocity_km_s"), F.col("combined_radius_m")))
    rows = rows.withColumn("confidence", scoring.confidence(F.col("max_epoch_age_hours"), F.col("min_perigee_km")))
    return rows.select(
        scoring.event_id(run if run is not None else F.lit("run"), F.col("primary_norad_id"), F.col("secondary_norad_id"), F.col("tca")).alias("event_id"),
        F.struct(F.col("primary_norad_id").alias("norad_id"), F.col("a_name").alias("name")).alias("primary"),
        F.struct(F.col("secondary_norad_id").alias("norad_id"), F.col("b_name").alias("name")).alias("secondary"),
        "tca",
        "miss_distance_km",
        "relative_velocity_km_s",
        "radial_km",
        "in_track_km",
        "cross_track_km",
        "combined_radius_m",
        "risk_score",
        scoring.risk_tier(F.col("risk_score")).alias("risk_tier"),
        "confidence",
        scoring.confidence_note(F.col("confidence"), F.col("max_epoch_age_hours"), F.col("min_perigee_km")).alias("confidence_note"),
        "max_epoch_age_hours",
        "screened_at",
        tle.intra_constellation(F.col("a_object_type"), F.col("a_name"), F.col("b_object_type"), F.col("b_name")).alias("intra_constellation"),
    )


def check_page(limit: int = 50, offset: int = 0, min_score: float | None = None, hours: float | None = None) -> None:
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit is 1 to {MOST_ROWS}")
    if offset < 0:
        raise ValueError("offset is 0 or more")
    if min_score is not None and not 0 <= min_score <= 1:
        raise ValueError("min_score is 0 to 1")
    if hours is not None and not 0 < hours <= 168:
        raise ValueError("hours is over 0, to 168")


def page(rows: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One page in the given order and, as a row with n, the number of all rows; neither is worked out before it is asked for."""
    check_page(limit, offset)
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("n"))


def filter_objects(objects: DataFrame, q: str | None = None, object_type: str | None = None) -> DataFrame:
    """Objects whose name contains q (literally, any case) and whose type is object_type."""
    if q:
        objects = objects.filter(F.lower("name").contains(q.lower()))
    return objects.filter(F.col("object_type") == object_type) if object_type else objects


def list_objects(objects: DataFrame, q: str | None = None, object_type: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
    return page(filter_objects(objects, q, object_type), ["norad_id"], limit, offset)


def filter_events(events: DataFrame, tier: str | None = None, since: Column | None = None, until: Column | None = None, min_score: float | None = None, exclude_intra: bool = False) -> DataFrame:
    """Events by tier, time of closest approach (both ends included), least score and constellation."""
    check_page(min_score=min_score)
    if tier is not None:
        events = events.filter(F.col("risk_tier") == tier)
    if since is not None:
        events = events.filter(F.col("tca") >= since)
    if until is not None:
        events = events.filter(F.col("tca") <= until)
    if min_score is not None:
        events = events.filter(F.col("risk_score") >= min_score)
    return events.filter(~F.col("intra_constellation")) if exclude_intra else events


def list_events(events: DataFrame, limit: int = 50, offset: int = 0, **filters) -> tuple[DataFrame, int]:
    return page(filter_events(events, **filters), ["tca", "event_id"], limit, offset)


def get_one(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.filter(F.col(key) == value).limit(1)


def with_names(events: DataFrame, objects: DataFrame) -> DataFrame:
    """Events with primary_norad_id and secondary_norad_id to events with both names; unknown ids drop out."""
    names = objects.select("norad_id", "name")
    a, b = (names.select(F.col("norad_id").alias(f"{p}_norad_id"), F.col("name").alias(f"{p}_name")) for p in ("primary", "secondary"))
    return events.join(a, "primary_norad_id").join(b, "secondary_norad_id")


def referenced_ids(events: DataFrame) -> DataFrame:
    return events.select(F.col("primary_norad_id").alias("norad_id")).union(events.select("secondary_norad_id")).distinct()


def missing_references(events: DataFrame, objects: DataFrame) -> DataFrame:
    return referenced_ids(events).join(objects, "norad_id", "left_anti")


def view_filter(events: DataFrame, now: Column, tiers: tuple[str, ...] = (), window_hours: float | None = None, min_score: float = 0.0) -> DataFrame:
    """The console's filter: no tiers means all; past approaches pass any window."""
    if tiers:
        events = events.filter(F.col("risk_tier").isin(*tiers))
    events = events.filter(F.col("risk_score") >= min_score)
    if window_hours is not None:
        events = events.filter(F.col("tca") <= now + F.make_dt_interval(hours=F.lit(0), secs=F.lit(window_hours * 3600)))
    return events


SORT_KEYS = {"tca": "asc", "primary": "asc", "secondary": "asc", "miss_distance_km": "asc", "relative_velocity_km_s": "desc", "risk_score": "desc", "confidence": "desc"}


def sort_events(events: DataFrame, key: str = "tca", direction: str | None = None) -> DataFrame:
    """By key, then tca and event_id; descending turns the tie-breaks round too. Names go by code point."""
    direction = direction or SORT_KEYS[key]
    column = f"{key}.name" if key in ("primary", "secondary") else key
    order = [F.col(c) for c in dict.fromkeys([column, "tca", "event_id"])]
    return events.orderBy(*(c.desc() if direction == "desc" else c.asc() for c in order))


def toggle_sort(key: str, direction: str, clicked: str) -> tuple[str, str]:
    if clicked == key:
        return key, "desc" if direction == "asc" else "asc"
    return clicked, SORT_KEYS[clicked]


def parse_view(query: str) -> dict:
    """Sort and filters from a query string, odd values replaced by defaults."""
    got = {k: v[-1] for k, v in parse_qs(query, keep_blank_values=True).items()}
    key = got.get("sort") if got.get("sort") in SORT_KEYS else "tca"
    asked = got.get("dir") if got.get("sort") in SORT_KEYS else None
    tiers = [t.strip().upper() for t in got.get("tier", "").split(",")]

    def number(text: str | None) -> float | None:
        try:
            x = float(text)  # type: ignore[arg-type]
        except (TypeError, ValueError):
            return None
        return x if x == x and abs(x) != float("inf") else None

    return {
        "sort": key,
        "dir": asked if asked in ("asc", "desc") else SORT_KEYS[key],
        "tiers": tuple(t for t in RISK_TIERS if t in tiers),
        "window_hours": number(got.get("window")),
        "min_score": min(1.0, max(0.0, number(got.get("min")) or 0.0)),
        "show_intra": got.get("intra") == "1",
    }


def is_default_filter(view: dict) -> bool:
    return not view["tiers"] and view["window_hours"] is None and view["min_score"] <= 0 and not view["show_intra"]


def write_view(view: dict) -> str:
    """The query string of a view, defaults left out."""
    out: dict[str, str] = {}
    if (view["sort"], view["dir"]) != ("tca", "asc"):
        out |= {"sort": view["sort"], "dir": view["dir"]}
    if view["tiers"]:
        out["tier"] = ",".join(t for t in RISK_TIERS if t in view["tiers"])
    if view["window_hours"] is not None:
        out["window"] = f"{view['window_hours']:g}"
    if view["min_score"] > 0:
        out["min"] = f"{view['min_score']:g}"
    if view["show_intra"]:
        out["intra"] = "1"
    return urlencode(out)


def tier_histogram(events: DataFrame) -> DataFrame:
    """A row for each tier, zero where there is no event."""
    counts = events.agg(*(F.count_if(F.col("risk_tier") == t).alias(t) for t in RISK_TIERS))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(t).alias("risk_tier"), F.col(t).alias("n")) for t in RISK_TIERS))).alias("r")).select("r.*")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), F.desc("id")).limit(1)


def catalog_status(objects: DataFrame, runs: DataFrame, now: Column, source: str = "database") -> DataFrame:
    """The status row: latest run, object count and ages at now; no row without a run."""
    aged = objects.withColumn("epoch_age_hours", tle.age_hours(F.col("epoch"), now))
    ages = age_summary(aged).select("object_count", F.struct("p50", "p90", "max").alias("epoch_age_hours"), F.lit(1).alias("one"))
    run = latest_run(runs).withColumn("one", F.lit(1))
    return run.join(ages, "one").select(
        "object_count",
        F.col("started_at").alias("last_refresh"),
        (F.col("started_at") + F.make_dt_interval(hours=F.lit(CACHE_HOURS))).alias("next_refresh"),
        F.lit(source).alias("source"),
        "epoch_age_hours",
        F.col("window_hours").alias("screening_window_hours"),
        F.col("duration_s").alias("last_screen_duration_s"),
        "pairs_considered",
        "pairs_fine_screened",
        "events_found",
    )


def health(events: DataFrame, mode: str = "database") -> DataFrame:
    return events.agg(F.count("*").alias("events_loaded")).select(F.lit("ok").alias("status"), F.lit(mode).alias("mode"), "events_loaded")


def circular_track(objects: DataFrame, now: Column, hours: float = 24.0, step_minutes: int = 5) -> DataFrame:
    """Ground track of a circular orbit of mean altitude, without earth rotation: the fallback series."""
    check_page(hours=hours)
    steps = int(hours * 60 / step_minutes)
    rows = objects.withColumn("alt", (F.col("perigee_km") + F.col("apogee_km")) / 2)
    radius_m = (F.lit(EARTH_RADIUS_KM) + F.col("alt")) * 1000
    period = 2 * F.pi() * F.sqrt(radius_m * radius_m * radius_m / F.lit(3.986004418e14)) / 60
    rows = rows.withColumn("period", period).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    turns = F.col("i") * float(step_minutes) / F.col("period")
    shifted = turns * 360.0 - 180.0
    wrapped = shifted - F.floor(shifted / 360.0) * 360.0 - 180.0
    return rows.select(
        "norad_id",
        "i",
        iso_utc(F.timestamp_micros(F.unix_micros(now) + F.col("i").cast("long") * (step_minutes * 60_000_000))).alias("t"),
        F.round(F.col("inclination_deg") * F.sin(2 * F.pi() * turns), 4).alias("lat_deg"),
        F.round(wrapped, 4).alias("lon_deg"),
        F.round("alt", 1).alias("alt_km"),
    )


def track_segments(points: DataFrame, key: str = "norad_id", order: str = "i") -> DataFrame:
    """Numbers the pieces of a track that a jump over the antimeridian separates."""
    by = Window.partitionBy(key).orderBy(order)
    jump = F.abs(F.col("lon_deg") - F.lag("lon_deg").over(by)) > 180
    return points.withColumn("_jump", F.coalesce(jump, F.lit(False)).cast("int")).withColumn("segment", F.sum("_jump").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_jump")


def nearest_sample(targets: DataFrame, samples: DataFrame, key: str, bin_s: int = 3600) -> DataFrame:
    """As-of join: the sample nearest in time to each target of the same key, earlier first on ties.

    targets: key, target (unix seconds); samples: key, t (unix seconds) and
    more. A key's time is cut into bins, so that no key meets in one task. A
    bin's targets and samples are merged in sorted passes; what lies before and
    after the bin comes from the last and the first sample of the bins beside
    it that have any, a small table of which each key's part is sorted. Adds
    gap_s and far (over 60 minutes).
    """
    others = [c for c in samples.columns if c not in (key, "t")]
    extra = [c for c in targets.columns if c not in (key, "target")]
    names = {c: f"own_{k}" for k, c in enumerate([key, *extra])}
    of = names[key]
    s = samples.select(F.col(key).alias(of), F.col("t").cast("double").alias("at"), F.struct("t", *others).alias("sample"))
    q = targets.select(F.col(key).alias(of), F.col("target").cast("double").alias("at"), F.struct(F.lit(1).alias("is"), *extra).alias("row"))
    binned = [x.withColumn("bin", F.floor(F.col("at") / bin_s)) for x in (s, q)]
    s, q = binned
    ends = s.groupBy(of, "bin").agg(F.min_by("sample", "at").alias("first"), F.max_by("sample", "at").alias("last"))
    places = ends.unionByName(q.select(of, "bin").distinct().join(ends, [of, "bin"], "left_anti"), allowMissingColumns=True)
    along, back = Window.partitionBy(of).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(of).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    beside = places.select(of, "bin", F.last("last", True).over(along).alias("earlier"), F.last("first", True).over(back).alias("later"))
    rows = s.withColumn("row", F.lit(None).cast(q.schema["row"].dataType)).unionByName(q.withColumn("sample", F.lit(None).cast(s.schema["sample"].dataType)))
    side = F.col("row").isNotNull()
    before = Window.partitionBy(of, "bin").orderBy("at", side).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(of, "bin").orderBy(F.desc("at"), side.desc()).rowsBetween(Window.unboundedPreceding, 0)
    merged = rows.withColumns({"b": F.last("sample", True).over(before), "a": F.last("sample", True).over(after)}).filter(side)
    merged = merged.join(beside, [of, "bin"], "left").withColumns({"b": F.coalesce("b", "earlier"), "a": F.coalesce("a", "later")})
    gap_b, gap_a = F.col("at") - F.col("b.t"), F.col("a.t") - F.col("at")
    pick = F.when(F.col("a").isNull() | (gap_b <= gap_a), F.col("b")).otherwise(F.col("a"))
    found = merged.withColumn("picked", pick).filter(F.col("picked").isNotNull())
    gap = F.abs(F.col("at") - F.col("picked.t"))
    return found.select(F.col(of).alias(key), F.col("at").alias("target"), *(F.col(f"row.{c}").alias(c) for c in extra), "picked.*", gap.alias("gap_s"), (gap > 3600).alias("far"))


def straight_line_geometry(events: DataFrame) -> DataFrame:
    """13 separations from a minute before the approach to a minute after, by the straight-line fallback."""
    offsets = F.sequence(F.lit(-60), F.lit(60), F.lit(10))
    rows = events.withColumn("offset_s", F.explode(offsets))
    separation = F.col("miss_distance_km") + F.abs(F.col("offset_s") / 60.0) * F.col("relative_velocity_km_s") * 6.0
    return rows.select("event_id", "offset_s", iso_utc(F.timestamp_micros(F.unix_micros("tca") + F.col("offset_s").cast("long") * 1_000_000)).alias("t"), F.round(separation, 3).alias("separation_km"))


def fresh_cache(cache: DataFrame, now: Column, ttl_s: int = 3600) -> DataFrame:
    """Cached series (event_id, computed_at, body) that are not older than ttl_s."""
    return cache.filter(F.unix_micros(now) - F.unix_micros("computed_at") <= ttl_s * 1_000_000)


def cached_geometry(events: DataFrame, cache: DataFrame, now: Column, ttl_s: int = 3600) -> tuple[DataFrame, DataFrame]:
    """(event_id and body of the events whose series is cached and fresh, the events that miss).

    Of several cached rows of an event the newest counts.
    """
    fresh = fresh_cache(cache, now, ttl_s).groupBy("event_id").agg(F.max_by("body", "computed_at").alias("body"))
    return events.select("event_id").join(fresh, "event_id"), events.join(fresh, "event_id", "left_anti")


def cache_rows(geometry: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the cache: each event's series as JSON, in order of its offsets."""
    series = F.array_sort(F.collect_list(F.struct("offset_s", *[c for c in geometry.columns if c not in ("event_id", "offset_s")])))
    return geometry.groupBy("event_id").agg(F.to_json(series).alias("body")).select("event_id", now.alias("computed_at"), "body")


def now_literal(at: datetime | str) -> Column:
    return F.to_timestamp(F.lit(at if isinstance(at, str) else at.isoformat()))
