"""Record layouts at the engine's edges, and the checks that belong to them."""

from __future__ import annotations

from pyspark.sql import types as T

OBJECT_TYPES = ("PAYLOAD", "ROCKET_BODY", "DEBRIS", "UNKNOWN")
RCS_SIZES = ("SMALL", "MEDIUM", "LARGE", "UNKNOWN")
RISK_TIERS = ("GREEN", "AMBER", "RED")


TYPES = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType()}


def _struct(fields: str, **nested: T.StructType) -> T.StructType:
    """'name type, name type, ...'; a nested struct is named in place of a type. No session is needed."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(name, nested.get(kind) or TYPES[kind]) for name, kind in pairs])


OBJECT_REF = _struct("norad_id int, name string")
AGES = _struct("p50 double, p90 double, max double")
CATALOG_SCHEMA = _struct(
    "norad_id int, name string, tle_line1 string, tle_line2 string, epoch timestamp, epoch_age_hours double, "
    "object_type string, rcs_size string, radius_m double, perigee_km double, apogee_km double, inclination_deg double"
)
EVENT_SCHEMA = _struct(
    "event_id string, primary ref, secondary ref, tca timestamp, "
    "miss_distance_km double, relative_velocity_km_s double, radial_km double, in_track_km double, cross_track_km double, "
    "combined_radius_m double, risk_score double, risk_tier string, confidence double, confidence_note string, "
    "max_epoch_age_hours double, screened_at timestamp, intra_constellation boolean",
    ref=OBJECT_REF,
)
STATUS_SCHEMA = _struct(
    "object_count long, last_refresh timestamp, next_refresh timestamp, source string, epoch_age_hours ages, screening_window_hours double, "
    "last_screen_duration_s double, pairs_considered long, pairs_fine_screened long, events_found long",
    ages=AGES,
)
RUN_SCHEMA = _struct("id long, started_at timestamp, window_hours double, objects_screened long, pairs_considered long, pairs_fine_screened long, events_found long, duration_s double")
STATE_SCHEMA = "norad_id int, step int, x double, y double, z double, vx double, vy double, vz double"
EPHEMERIS_SCHEMA = "norad_id int, frame string, px array<double>, py array<double>, pz array<double>, vx array<double>, vy array<double>, vz array<double>, error string"
APPROACH_SCHEMA = (
    "primary_norad_id int, secondary_norad_id int, tca timestamp, miss_distance_km double, relative_velocity_km_s double, radial_km double, in_track_km double, cross_track_km double"
)
