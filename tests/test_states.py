"""Frames both ways, passages of perigee and node, and the ephemeris function of SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import frames, tle
from skyloom.operators import screening, states

START = 1221955140.0
ISS = ("ISS (ZARYA)", "1 25544U 98067A   08264.51782528 -.00002182  00000-0 -11606-4 0  2927", "2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537")
BAD = ("BAD", ISS[1][:-1] + "0", ISS[2])
COLUMNS = "norad_id int, t_s double, frame string, x double, y double, z double, vx double, vy double, vz double, note string"


def parsed(spark):
    rows = spark.createDataFrame([ISS, BAD], "name string, line1 string, line2 string")
    return tle.parse(rows, F.timestamp_seconds(F.lit(int(START))))


@pytest.mark.parametrize("path", [("GCRS", "ITRF", "GCRS"), ("TEME", "ITRF", "GCRS", "TEME"), ("ITRF", "TEME", "GCRS", "ITRF")])
def test_frames_there_and_back(spark, path):
    rng = np.random.default_rng(3)
    rows = [(k, 1.7e9 + 1e5 * k, path[0], *map(float, 7000 * rng.normal(size=3)), *map(float, 7 * rng.normal(size=3)), "n") for k in range(40)]
    df = spark.createDataFrame(rows, COLUMNS)
    for target in path[1:]:
        df = states.to_frame(df, target)
    assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    for a, b in zip(sorted(map(tuple, df.collect())), rows, strict=True):
        assert a[:3] == b[:3] and a[9] == "n"
        assert np.allclose(a[3:6], b[3:6], atol=1e-6) and np.allclose(a[6:9], b[6:9], atol=1e-6)  # a millimetre, a millimetre a second


def test_earth_fixed_velocity_is_the_positions_change():
    t = 1.7e9 + np.array([-0.5, 0.0, 0.5])
    v = np.array([1.0, -7.0, 2.0])
    p = np.array([7000.0, 100.0, -900.0]) + v * (t - 1.7e9)[:, None]
    fixed, moved = frames.earth_fixed(p, np.tile(v, (3, 1)), t)
    assert np.allclose(moved[1], fixed[2] - fixed[0], atol=1e-6)
    # a point that turns with the Earth stands still
    still = frames.earth_fixed(*frames.from_earth_fixed(np.tile([6378.0, 0.0, 0.0], (3, 1)), np.zeros((3, 3)), t), t)
    assert np.allclose(still[0], [6378.0, 0.0, 0.0], atol=1e-9) and np.allclose(still[1], 0, atol=1e-12)


def test_odd_states(spark):
    rows = [(1, None, "TEME", *[1.0] * 6, None), (2, 0.0, None, *[1.0] * 6, None), (3, 0.0, "TEME", None, *[1.0] * 5, None), (4, 0.0, "GCRS", *[1.0] * 6, None), (4, 0.0, "GCRS", *[1.0] * 6, None)]
    out = states.to_frame(spark.createDataFrame(rows, COLUMNS), "ITRF").orderBy("norad_id").collect()
    assert [r.x is None for r in out] == [True, True, True, False, False] and {r.frame for r in out} == {"ITRF"}
    assert states.to_frame(spark.createDataFrame([], COLUMNS), "GCRS").count() == 0
    with pytest.raises(ValueError):
        states.to_frame(spark.createDataFrame([], COLUMNS), "MOON")
    with pytest.raises(Exception, match="frames are"):
        states.to_frame(spark.createDataFrame([(5, 0.0, "MOON", *[1.0] * 6, None)], COLUMNS), "ITRF").collect()


def test_perigee_passages_are_a_period_apart(spark):
    eph = screening.ephemeris(parsed(spark), START, 24, 60)
    samples = states.samples_of(eph, START, 60)
    found = states.perigee_passages(samples).orderBy("at").collect()
    rows = samples.orderBy("t_s").toPandas()
    radial = (rows[["x", "y", "z"]].to_numpy() * rows[["vx", "vy", "vz"]].to_numpy()).sum(1) / np.linalg.norm(rows[["x", "y", "z"]], axis=1)
    k = np.flatnonzero((radial[:-1] < 0) & (radial[1:] >= 0))
    at = rows["t_s"].to_numpy()[k] - radial[k] / (radial[k + 1] - radial[k]) * 60
    assert len(at) >= 10 and np.allclose([r["at"] for r in found], at, atol=1e-6)
    assert found[0].since is None and np.allclose([r.since for r in found[1:]], np.diff(at), atol=1e-6)
    nodes = [r.since / 60 for r in states.node_passages(samples).orderBy("at").collect()[1:]]
    assert 91 < min(nodes) <= max(nodes) < 93


def test_crossings_of_odd_series(spark):
    rows = [("a", 0.0, -1.0), ("a", 1.0, None), ("a", 2.0, 1.0), ("a", 2.0, 3.0), ("a", 3.0, 0.0), ("a", 4.0, -2.0), ("a", 5.0, 0.0), ("b", 0.0, 1.0), ("b", None, -1.0), (None, 0.0, -1.0), (None, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    found = {(r.k, r["at"]): r.since for r in states.rising_crossings(df, "k", "t", F.col("v")).collect()}
    assert found == {("a", 1.0): None, ("a", 5.0): 4.0, (None, 2.0): None}


def test_ephemeris_in_sql(spark):
    states.register_functions(spark)
    elements = parsed(spark).filter("parse_error is null").withColumn("epoch_s", F.unix_micros("epoch") / 1e6)
    args = "c.mean_motion, c.eccentricity, c.inclination_deg, c.raan_deg, c.arg_perigee_deg, c.mean_anomaly_deg, c.bstar, c.epoch_s"
    got = spark.sql(f"SELECT c.norad_id, e.* FROM {{el}} c, LATERAL ephemeris({args}, {{at}}, 2.0D, 60) e ORDER BY step", el=elements, at=START).toPandas()
    want = states.samples_of(screening.ephemeris(parsed(spark), START, 2, 60), START, 60).orderBy("step").toPandas()
    assert len(got) == 121 and got["error"].isna().all()
    assert np.allclose(got[list(states.STATE)], want[list(states.STATE)], atol=1e-9) and np.allclose(got["t_s"], want["t_s"])
    odd = spark.sql(f"SELECT e.* FROM {{el}} c, LATERAL ephemeris({args}, NULL, 2.0D, 60) e", el=elements).collect()
    assert len(odd) == 1 and odd[0].error and odd[0].x is None
