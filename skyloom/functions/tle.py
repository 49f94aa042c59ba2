"""Two-line element sets as Column expressions: all of it stays in generated JVM code.

Errors are a column (parse_error), not exceptions: casts are try_cast, and a
ladder of conditions names the first check that a record fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.constants import CONSTELLATIONS, EARTH_RADIUS_KM, MU_KM3_S2, RADIUS_BY_RCS


def checksum(line: Column) -> Column:
    """Sum modulo 10 of the first 68 characters: a digit counts itself, a minus sign 1."""
    head = F.substring(line, 1, 68)
    digits = reduce(lambda a, b: a + b, (F.length(head) * 0 + d * (F.length(head) - F.length(F.replace(head, F.lit(str(d))))) for d in range(1, 10)))
    minus = F.length(head) - F.length(F.replace(head, F.lit("-")))
    return ((digits + minus) % 10).cast("int")


def checksum_ok(line: Column) -> Column:
    last = F.substring(line, 69, 1)
    return last.rlike("^[0-9]$") & (last.try_cast("int") == checksum(line))


def field(line: Column, start: int, stop: int) -> Column:
    """Characters start to stop (0-based, stop exclusive) without outer blanks."""
    return F.trim(F.substring(line, start + 1, stop - start))


def fixed_float(line: Column, start: int, stop: int) -> Column:
    return field(line, start, stop).try_cast("double")


def implied_exponential(text: Column) -> Column:
    """' 12345-4' is 0.12345e-4; blank is 0; null if malformed."""
    t = F.trim(text)
    shape = r"^([+-]?)([0-9]+)([+-][0-9]+)$"
    size = F.concat(F.lit("0."), F.regexp_extract(t, shape, 2)).try_cast("double") * F.pow(F.lit(10.0), F.regexp_extract(t, shape, 3).try_cast("double"))
    signed = F.when(F.regexp_extract(t, shape, 1) == "-", -size).otherwise(size)
    return F.when(t == "", F.lit(0.0)).when(t.rlike(shape), signed)


def epoch(text: Column) -> Column:
    """YYDDD.DDDDDDDD, years from 57 on in the 1900s, as a timestamp to the microsecond; null if malformed."""
    yy, day = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 3, 12).try_cast("decimal(18,8)")
    year = F.when(yy >= 57, 1900 + yy).otherwise(2000 + yy)
    micros = F.round((day - 1) * 86400 * 1000000, 0).cast("long")
    start = F.unix_micros(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return F.when(yy.isNotNull() & (day >= 1), F.timestamp_micros(start + micros))


def semi_major_axis(mean_motion: Column) -> Column:
    n = mean_motion * (2 * F.pi()) / 86400.0
    return F.pow(F.lit(MU_KM3_S2) / (n * n), F.lit(1.0 / 3.0))


def perigee(mean_motion: Column, eccentricity: Column) -> Column:
    return semi_major_axis(mean_motion) * (1 - eccentricity) - EARTH_RADIUS_KM


def apogee(mean_motion: Column, eccentricity: Column) -> Column:
    return semi_major_axis(mean_motion) * (1 + eccentricity) - EARTH_RADIUS_KM


def age_hours(at: Column, now: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at)) / F.lit(3.6e9))


def pair_ok(line1: Column, line2: Column) -> Column:
    """Both lines have 69 characters, lead with their number, agree on the id and have good checksums."""
    lengths = (F.length(line1) == 69) & (F.length(line2) == 69)
    leads = (F.substring(line1, 1, 1) == "1") & (F.substring(line2, 1, 1) == "2")
    return F.coalesce(lengths & leads & (field(line1, 2, 7) == field(line2, 2, 7)) & checksum_ok(line1) & checksum_ok(line2), F.lit(False))


def classify(name: Column) -> Column:
    """Object type by the tokens of the name."""
    upper = F.trim(F.upper(F.coalesce(name, F.lit(""))))
    tokens = F.split(F.regexp_replace(upper, r"[()]", " "), r"\s+")
    rocket = F.exists(tokens, lambda t: t.startswith("R/B"))
    return F.when(upper == "", "UNKNOWN").when(F.array_contains(tokens, "DEB"), "DEBRIS").when(rocket, "ROCKET_BODY").otherwise("PAYLOAD")


def radius_of(rcs_size: Column) -> Column:
    out = F.when(F.lit(False), 0.0)
    for size, radius in RADIUS_BY_RCS.items():
        out = out.when(rcs_size == size, radius)
    return out.otherwise(RADIUS_BY_RCS["UNKNOWN"])


def constellation(name: Column) -> Column:
    upper = F.trim(F.upper(name))
    return F.coalesce(*(F.when(upper.startswith(c), c) for c in CONSTELLATIONS))


def intra_constellation(type_a: Column, name_a: Column, type_b: Column, name_b: Column) -> Column:
    """Both payloads of one constellation; false where either has none."""
    both = (type_a == "PAYLOAD") & (type_b == "PAYLOAD")
    return F.coalesce(both & (constellation(name_a) == constellation(name_b)), F.lit(False))


def parse(records: DataFrame, now: Column) -> DataFrame:
    """name, line1, line2 to all fields and parse_error (null for a good record)."""
    name = F.trim(F.regexp_replace(F.trim("name"), r"^0 ", ""))
    one, two = F.regexp_replace("line1", r"[\r\n]+$", ""), F.regexp_replace("line2", r"[\r\n]+$", "")
    n, e = fixed_float(F.col("line2"), 52, 63), F.concat(F.lit("0."), field(F.col("line2"), 26, 33)).try_cast("double")
    clean = records.withColumns({"name": name, "line1": one, "line2": two})
    # the fields pass through a generator, which predicates on them are not rewritten across
    fields = F.struct(
        F.col("name"),
        F.col("line1"),
        F.col("line2"),
        field(F.col("line1"), 2, 7).alias("id_text"),
        F.substring("line1", 8, 1).alias("class_text"),
        field(F.col("line1"), 9, 17).alias("intl_designator"),
        epoch(F.substring("line1", 19, 14)).alias("epoch"),
        implied_exponential(F.substring("line1", 54, 8)).alias("bstar"),
        fixed_float(F.col("line2"), 8, 16).alias("inclination_deg"),
        fixed_float(F.col("line2"), 17, 25).alias("raan_deg"),
        F.when(field(F.col("line2"), 26, 33).rlike("^[0-9]+$"), e).alias("eccentricity"),
        fixed_float(F.col("line2"), 34, 42).alias("arg_perigee_deg"),
        fixed_float(F.col("line2"), 43, 51).alias("mean_anomaly_deg"),
        n.alias("mean_motion"),
        checksum_ok(F.col("line1")).alias("ok1"),
        checksum_ok(F.col("line2")).alias("ok2"),
    )
    others = [c for c in records.columns if c not in ("name", "line1", "line2")]
    out = clean.select(*others, F.inline(F.array(fields)))
    numbers = ("inclination_deg", "raan_deg", "arg_perigee_deg", "mean_anomaly_deg", "mean_motion")
    checks = [
        (F.length("name") == 0, "empty name"),
        ((F.length("line1") != 69) | (F.length("line2") != 69), "line length is not 69"),
        ((F.substring("line1", 1, 1) != "1") | (F.substring("line2", 1, 1) != "2"), "line number"),
        (~F.col("ok1"), "line 1 checksum"),
        (~F.col("ok2"), "line 2 checksum"),
        (F.col("id_text") != field(F.col("line2"), 2, 7), "catalogue numbers differ"),
        (F.col("id_text").try_cast("int").isNull(), "catalogue number is not a number"),
        (F.col("epoch").isNull(), "epoch"),
        (F.col("bstar").isNull(), "drag term"),
        (reduce(lambda a, b: a | b, (F.col(c).isNull() for c in numbers)), "mean elements"),
        (F.col("eccentricity").isNull() | (F.col("eccentricity") >= 1), "eccentricity"),
        (F.col("mean_motion") <= 0, "mean motion"),
        (~F.col("inclination_deg").between(0, 180), "inclination"),
    ]
    error = F.when(F.col("line1").isNull() | F.col("line2").isNull() | F.col("name").isNull(), "missing line")
    for failed, what in checks:
        error = error.when(failed, what)
    good = F.col("mean_motion") > 0
    derived = F.struct(
        error.alias("parse_error"),
        F.col("id_text").try_cast("int").alias("norad_id"),
        F.when(F.trim("class_text") == "", "U").otherwise(F.col("class_text")).alias("classification"),
        F.when(good, perigee(F.col("mean_motion"), F.col("eccentricity"))).alias("perigee_km"),
        F.when(good, apogee(F.col("mean_motion"), F.col("eccentricity"))).alias("apogee_km"),
        age_hours(F.col("epoch"), now).alias("epoch_age_hours"),
    )
    return out.select("*", F.inline(F.array(derived))).drop("id_text", "class_text", "ok1", "ok2")
