"""Risk score, tier and confidence. The score is no probability, and no function here computes one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom import constants as K


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def risk_score(miss_km: Column, speed_km_s: Column, radius_m: Column) -> Column:
    miss = clip(1 - miss_km / K.MISS_SCALE_KM, 0, 1)
    speed = clip(speed_km_s / K.SPEED_SCALE_KM_S, 0, 1)
    return K.MISS_WEIGHT * miss + K.SPEED_WEIGHT * speed + K.RADIUS_WEIGHT * clip(radius_m / K.RADIUS_SCALE_M, 0, 1)


def risk_tier(score: Column) -> Column:
    return F.when(score >= K.RED_FROM, "RED").when(score >= K.AMBER_FROM, "AMBER").otherwise("GREEN")


def confidence(age_h: Column, perigee_km: Column) -> Column:
    low = F.when(perigee_km < K.LOW_ORBIT_PERIGEE_KM, K.LOW_ORBIT_PENALTY).otherwise(0.0)
    return clip(1 - K.AGE_PENALTY * clip(age_h / K.AGE_FULL_HOURS, 0, 1) - low, K.LEAST_CONFIDENCE, 1)


def confidence_note(score: Column, age_h: Column, perigee_km: Column) -> Column:
    c, a = (F.call_function("format_number", x, F.lit(pattern)) for x, pattern in ((score, "0.00"), (age_h, "0")))

    def fill(template: str) -> Column:
        before, rest = template.split("{c}")
        between, after = rest.split("{a}")
        return F.concat(F.lit(before), c, F.lit(between), a, F.lit(after))

    low = perigee_km < K.LOW_ORBIT_PERIGEE_KM
    stale, aged = age_h >= K.AGE_FULL_HOURS, age_h >= K.AGE_NOTED_HOURS
    note = F.when(stale & low, fill(K.NOTE_STALE_LOW)).when(stale, fill(K.NOTE_STALE)).when(aged & low, fill(K.NOTE_AGED_LOW))
    return note.when(aged, fill(K.NOTE_AGED)).when(low, fill(K.NOTE_LOW)).otherwise(fill(K.NOTE_FRESH))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "reduced").otherwise("low")


def event_id(run: Column, primary: Column, secondary: Column, tca: Column) -> Column:
    """A stable id in UUID form: screening again gives the same ids."""
    h = F.md5(F.concat_ws("|", run.cast("string"), primary.cast("string"), secondary.cast("string"), F.date_format(tca, "yyyy-MM-dd HH:mm:ss")))
    return F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
