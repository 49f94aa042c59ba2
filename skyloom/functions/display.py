"""Labels, formats and projections of the presentation layer as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def split_iso(iso: Column) -> tuple[Column, Column]:
    """Date and time part of an ISO string, fractional seconds dropped."""
    return F.split(iso, "T")[0], F.regexp_replace(F.coalesce(F.try_element_at(F.split(iso, "T"), F.lit(2)), F.lit("")), r"\.[0-9]+", "")


def relative_label(seconds: Column) -> Column:
    """'in 3d 4h', '5d 2h ago': seconds from now to the instant, past ones negative."""
    s = F.abs(seconds)
    d, h, m = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60)
    part = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(unit))
    core = F.when(d > 0, F.concat(part(d, "d "), part(h, "h"))).when(h > 0, F.concat(part(h, "h "), part(m, "m"))).when(m > 0, part(m, "m")).otherwise(F.lit("<1m"))
    return F.when(seconds < 0, F.concat(core, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), core))


def compact_count(n: Column) -> Column:
    """Thousands separators below a million, else one decimal and an exponent: 4.5e8. A tie takes the larger digit."""
    # from the decimal digits, as a quotient of doubles may miss a tie
    digits = F.substring_index(F.call_function("format_number", F.abs(n), F.lit("0.############")), ".", 1)
    tenths = F.substring(digits, 1, 2).try_cast("int") + F.when(F.substring(digits, 3, 1) >= "5", 1).otherwise(0)
    power = F.length(digits) - 1 + F.when(tenths >= 100, 1).otherwise(0)
    tenths = F.when(tenths >= 100, 10).otherwise(tenths)
    lead = F.concat((tenths / 10).cast("int").cast("string"), F.lit("."), (tenths % 10).cast("string"))
    large = F.concat(F.when(n < 0, "-").otherwise(""), lead, F.lit("e"), power.cast("string"))
    return F.when(F.abs(n) >= 1_000_000, large).otherwise(F.format_number(n, 0))


def hours_label(h: Column) -> Column:
    return F.concat(F.floor(h + 0.5).cast("long").cast("string"), F.lit(" h"))


def window_label(h: Column) -> Column:
    days = F.concat(F.lit("next "), (h / 24).cast("int").cast("string"), F.lit(" d"))
    return F.when(h.isNull(), "any time").when(h % 24 == 0, days).otherwise(F.concat(F.lit("next "), h.cast("string"), F.lit(" h")))


def gauge_fill(confidence: Column) -> Column:
    return F.greatest(F.lit(4), F.least(F.lit(100), F.floor(confidence * 100 + 0.5).cast("int")))


def is_stale(max_age_h: Column) -> Column:
    return max_age_h >= 168


def encounter_plane(radial: Column, in_track: Column, cross: Column, radius_m: Column, radius_px: float = 150.0) -> list[Column]:
    """Polar position of an encounter on a logarithmic disc of radius_px, its decade rings, and which side it passes."""
    body = radius_m / 1000
    in_plane = F.hypot(cross, radial)
    least, most = F.greatest(body / 3, F.lit(1e-4)), F.greatest(in_plane, F.lit(10.0)) * 1.15
    low, high = F.log10(least), F.log10(most)

    def on_disc(km: Column) -> Column:
        return F.when(km <= least, 0.0).otherwise(radius_px * (F.log10(km) - low) / (high - low))

    bearing = F.when(in_plane == 0, 0.0).otherwise(F.atan2(radial, cross))
    return [
        in_plane.alias("in_plane_km"),
        on_disc(in_plane).alias("r_px"),
        bearing.alias("bearing_rad"),
        on_disc(body).alias("keepout_px"),
        (F.floor(high) - F.ceil(low) + 1).cast("int").alias("n_rings"),
        F.when(in_track >= 0, "ahead of").otherwise("behind").alias("side"),
    ]


def rings(low: Column, high: Column) -> Column:
    """Radii 10^p km of the decade rings between two radii."""
    powers = F.sequence(F.ceil(F.log10(low)).cast("int"), F.floor(F.log10(high)).cast("int"))
    return F.transform(powers, lambda p: F.pow(F.lit(10.0), p.cast("double")))


def equirectangular(lon: Column, lat: Column, width: float = 360.0, height: float = 180.0) -> tuple[Column, Column]:
    return (lon + 180) / 360 * width, (90 - lat) / 180 * height
