"""Checks of event records, and exports that write all or nothing."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.schemas import CATALOG_SCHEMA, EVENT_SCHEMA, RISK_TIERS, STATUS_SCHEMA

UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
AT_LEAST_0 = ("miss_distance_km", "relative_velocity_km_s", "max_epoch_age_hours")
IN_0_TO_1 = ("risk_score", "confidence")


#: What JSON shows for values of a field's type, and what the reader calls it.
KINDS = {
    "string": ("^STRING$", "a string"),
    "integer": ("^BIGINT$", "a whole number"),
    "double": ("^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "a number"),
    "timestamp": ("^STRING$", "a date-time"),
    "boolean": ("^BOOLEAN$", "true or false"),
    "struct": ("^(OBJECT|STRUCT)", "an object"),
}
DATE_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def _as_written(raw: Column) -> list[tuple[Column, str]]:
    """What only a record's text shows: missing fields, values of another type, and dates of another form."""
    whole = F.try_parse_json(raw)
    found = []

    def look(path: str, kind: str, told: Column) -> None:
        seen = F.schema_of_variant(F.try_variant_get(whole, f"$.{path}", "variant"))
        pattern, name = KINDS[kind]
        missing = seen.isNull() | (seen == "VOID")
        found.append((told & missing, f"{path}: required"))
        found.append((told & ~missing & ~seen.rlike(pattern), f"{path}: not {name}"))
        if kind == "timestamp":
            text = F.try_variant_get(whole, f"$.{path}", "string")
            found.append((told & ~missing & seen.rlike(pattern) & (~text.rlike(DATE_TIME) | text.try_cast("timestamp").isNull()), f"{path}: not a date-time"))

    for f in EVENT_SCHEMA:
        look(f.name, f.dataType.typeName(), F.lit(True))
        if f.dataType.typeName() == "struct":
            there = F.schema_of_variant(F.try_variant_get(whole, f"$.{f.name}", "variant")).rlike(KINDS["struct"][0])
            for inner in f.dataType:
                look(f"{f.name}.{inner.name}", inner.dataType.typeName(), F.coalesce(there, F.lit(False)))
    return found


def _as_read() -> list[tuple[Column, str]]:
    """Missing fields of rows that have no text."""
    found = [(F.col(field).isNull(), f"{field}: required") for field in EVENT_SCHEMA.fieldNames()]
    for side in ("primary", "secondary"):
        found += [(F.col(side).isNotNull() & F.col(f"{side}.{c}").isNull(), f"{side}.{c}: required") for c in ("norad_id", "name")]
    return found


def violations(raw: Column | None = None) -> Column:
    """An array of 'path: message', ordered by path, for rows of the event schema.

    raw is the record's JSON text, where there is one: only there unknown
    fields, wrong types and the form of dates can be seen.
    """
    found = _as_read() if raw is None else _as_written(raw)
    for side in ("primary", "secondary"):
        found += [(F.col(f"{side}.norad_id") < 1, f"{side}.norad_id: less than 1"), (F.length(f"{side}.name") < 1, f"{side}.name: empty")]
    found += [(F.col(c) < 0, f"{c}: less than 0") for c in AT_LEAST_0]
    found += [(~F.col(c).between(0, 1), f"{c}: not in 0 to 1") for c in IN_0_TO_1]
    found += [(F.col("combined_radius_m") <= 0, "combined_radius_m: not above 0"), (~F.col("event_id").rlike(UUID), "event_id: not a uuid"), (~F.col("risk_tier").isin(*RISK_TIERS), "risk_tier: unknown")]
    listed = F.filter(F.array(*(F.when(c, F.lit(text)) for c, text in found)), lambda x: x.isNotNull())
    if raw is not None:
        known = F.array(*(F.lit(c) for c in EVENT_SCHEMA.fieldNames()))
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), known), lambda k: F.concat(k, F.lit(": unknown field")))
        listed = F.concat(listed, extra)
    return F.array_sort(listed)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON array file, all checked; any violation raises with all of them named.

    A file that is not one whole JSON array raises too.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    form = F.schema_of_variant(F.try_parse_json("value"))
    broken = text.filter(form.isNull() | ~F.coalesce(form, F.lit("")).rlike("^ARRAY")).select("path").collect()
    if broken or text.isEmpty():
        raise ValueError("\n".join(f"{r.path}: not a JSON array" for r in broken) or f"{path}: empty, not a JSON array")
    items = text.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "raw"))
    rows = items.select("pos", "raw", F.from_json("raw", EVENT_SCHEMA).alias("e")).select("pos", "raw", "e.*")
    checked = rows.withColumn("bad", violations(F.col("raw")))
    report = F.concat(F.lit("event["), F.col("pos").cast("string"), F.lit("] ("), F.coalesce("event_id", F.lit("?")), F.lit("): "), F.array_join("bad", "; "))
    bad = checked.filter(F.size("bad") > 0).orderBy("pos").select(report.alias("r")).collect()
    if bad:
        raise ValueError("\n".join(r.r for r in bad))
    return rows.drop("raw").orderBy("pos").drop("pos")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_status(spark: SparkSession, path: str | None, window_hours: float = 72.0) -> DataFrame:
    """Run counters of a status file; without one the defaults, with zeros."""
    zero = {"screening_window_hours": window_hours, "last_screen_duration_s": 0.0, "pairs_considered": 0, "pairs_fine_screened": 0, "events_found": 0}
    if path is None:
        return spark.range(1).select(*(F.lit(v).alias(k) for k, v in zero.items()))
    return spark.read.schema(STATUS_SCHEMA).option("multiLine", True).json(path).na.fill(zero)


def export_events(events: DataFrame, path: str) -> int:
    """Write events as one JSON array of indent 2, or nothing at all if any violates the schema.

    The file is a report for people and small by its contract, so it passes
    through the driver; bulk output is write_events.
    """
    checked = events.select("*", violations().alias("bad"))
    bad = checked.filter(F.size("bad") > 0).select("event_id", F.array_join("bad", "; ").alias("bad")).orderBy("event_id").collect()
    if bad:
        raise ValueError("\n".join(f"event ({r.event_id}): {r.bad}" for r in bad))
    stamp = {f.name: F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f.name) for f in EVENT_SCHEMA if f.dataType.typeName() == "timestamp"}
    rows = [json.loads(r.j) for r in events.orderBy("tca", "event_id").select(F.to_json(F.struct(*(stamp.get(c, F.col(c)) for c in EVENT_SCHEMA.fieldNames()))).alias("j")).toLocalIterator()]
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as out:
        json.dump(rows, out, indent=2)
        out.write("\n")
    os.replace(out.name, path)
    return len(rows)


def write_events(events: DataFrame, path: str) -> None:
    """Events as Parquet, clustered by time so that readers skip files by tca."""
    events.repartitionByRange("tca").sortWithinPartitions("tca").write.mode("append").parquet(path)
