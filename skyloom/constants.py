"""Fixed values that results depend on: physical constants, screening pads, scoring weights and texts."""

# geometry of mean elements (WGS-84)
MU_KM3_S2 = 398600.4418
EARTH_RADIUS_KM = 6378.137
FLATTENING = 1 / 298.257223563

# catalogue
CACHE_HOURS = 6
RADIUS_BY_RCS = {"SMALL": 0.5, "MEDIUM": 2.5, "LARGE": 10.0, "UNKNOWN": 1.0}
CONSTELLATIONS = ("STARLINK", "ONEWEB", "GLOBALSTAR", "IRIDIUM")
SAMPLE_SEED = 20260829
LEO_PERIGEE_KM = 2000.0
LEO_WEIGHT = 4.0

# funnel
BAND_PAD_KM = 100.0
BAND_MARGIN_KM = 25.0
THRESHOLD_KM = 10.0
COARSE_STEP_S = 60
COARSE_STRIDE = 5
CHORD_ACCELERATION_KM_S2 = 2.0e-2
CHORD_PADS_KM = {60: 12.0, 300: 240.0}

# scoring
MISS_SCALE_KM, SPEED_SCALE_KM_S, RADIUS_SCALE_M = 10.0, 15.0, 100.0
MISS_WEIGHT, SPEED_WEIGHT, RADIUS_WEIGHT = 0.60, 0.30, 0.10
RED_FROM, AMBER_FROM = 0.70, 0.40
AGE_FULL_HOURS, AGE_NOTED_HOURS = 168.0, 24.0
AGE_PENALTY, LOW_ORBIT_PENALTY, LEAST_CONFIDENCE = 0.70, 0.20, 0.05
LOW_ORBIT_PERIGEE_KM = 500.0

# confidence notes: {c} the confidence to 2 places, {a} the older age in whole hours
NOTE_STALE_LOW = (
    "Low confidence ({c}): the older of the two TLEs is {a} h old — past the 168 h point where TLE predictions are treated as stale — "
    "and the lower object's perigee is below 500 km, where atmospheric drag makes those predictions degrade fastest."
)
NOTE_STALE = "Low confidence ({c}): the older of the two TLEs is {a} h old, past the 168 h point where TLE predictions are treated as stale; the maximum age penalty is applied."
NOTE_AGED_LOW = "Reduced confidence ({c}): the older of the two TLEs is {a} h old, and the lower object's perigee is below 500 km, where atmospheric drag makes TLE predictions degrade fastest."
NOTE_AGED = "Reduced confidence ({c}): the older of the two TLEs is {a} h old and TLE accuracy decays with epoch age."
NOTE_LOW = (
    "Slightly reduced confidence ({c}): both TLEs are recent (older epoch {a} h), but the lower object's perigee is below 500 km, "
    "where atmospheric drag makes TLE predictions degrade fastest."
)
NOTE_FRESH = "High confidence ({c}): both TLEs are recent (older epoch {a} h) and neither object's perigee is below 500 km."
