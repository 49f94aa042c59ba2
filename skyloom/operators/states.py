"""State vectors as rows: frames, passages through events of an orbit, and ephemerides as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from skyloom.functions import frames, sgp4
from skyloom.operators.funnel import with_motion

STATE = ("x", "y", "z", "vx", "vy", "vz")
#: Samples of an ephemeris that are worked out at a time.
SAMPLES_AT_ONCE = 4096


def to_frame(states: DataFrame, target: str) -> DataFrame:
    """States in another frame: rows with frame (TEME, GCRS or ITRF), t_s (unix seconds), x, y, z, vx, vy, vz; other columns stay.

    A row whose state, time or frame is null keeps null values; another frame
    raises. Velocities in ITRF are those seen from the turning Earth.
    """
    if target not in frames.FRAMES:
        raise ValueError(f"frames are {', '.join(frames.FRAMES)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float) for c in (*STATE, "t_s")], -1)
            own, out = np.array(batch.column("frame").to_pylist(), object), np.full((batch.num_rows, 6), np.nan)
            for source in set(own.tolist()) - {None}:
                k = np.flatnonzero((own == source) & np.isfinite(values).all(1))
                out[k] = np.concatenate(frames.convert(values[k, :3], values[k, 3:6], values[k, 6], source, target), 1)
            new = {c: pa.array(out[:, i], mask=np.isnan(out[:, i])) for i, c in enumerate(STATE)} | {"frame": pa.array([target] * batch.num_rows)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    doubled = states.withColumns({c: F.col(c).cast("double") for c in STATE})
    return doubled.mapInArrow(run, doubled.schema)


def rising_crossings(series: DataFrame, key: str, at: str, value: Column) -> DataFrame:
    """Where the value of each key's ordered series rises through zero: key, at (between samples, on a straight line) and since, the span from the crossing before.

    A crossing lies between a negative sample and a next one that is not
    negative. Samples without a value or time are left out; of repeated times
    the least value counts. since is null for a key's first crossing.
    """
    samples = series.select(key, F.col(at).alias("at"), value.alias("value")).filter("at is not null and value is not null")
    # one sort, which can go to disk, and what follows streams: a table of (key, at) to aggregate by would not
    first, order = Window.partitionBy(key).orderBy("at", "value"), Window.partitionBy(key).orderBy("at")
    told = samples.withColumn("before", F.lag("at").over(first)).filter("before is null or before <> at").drop("before")
    steps = told.withColumns({"at0": F.lag("at").over(order), "value0": F.lag("value").over(order)}).filter("value0 < 0 and value >= 0")
    found = steps.withColumn("crossed", _between(F.col("at0"), F.col("value0"), F.col("at"), F.col("value")))
    return found.withColumn("since", F.col("crossed") - F.lag("crossed").over(order)).select(key, F.col("crossed").alias("at"), "since")


def crossings_in_row(series: Column) -> Column:
    """rising_crossings of a row's own series, an array of (at, value) without nulls in order of time: an array of (at, since)."""
    # bound as lambdas' variables, arrays are worked out once
    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def rises(samples: Column) -> Column:
        def rise(x: Column, i: Column) -> Column:
            before = F.get(samples, i - 1)
            return F.when((x["value"] >= 0) & (before["value"] < 0), _between(before["at"], before["value"], x["at"], x["value"]))

        return F.array_compact(F.transform(samples, rise))

    spans = lambda found: F.transform(found, lambda x, i: F.struct(x.alias("at"), (x - F.get(found, i - 1)).alias("since")))
    return bound(bound(series, rises), spans)


def _between(at0: Column, value0: Column, at: Column, value: Column) -> Column:
    """When a straight line between two samples goes through zero."""
    return at0 - value0 / (value - value0) * (at - at0)


def samples_of(eph: DataFrame, start_s: float, step_s: int) -> DataFrame:
    """The rows of an ephemeris as one row a sample: norad_id, frame, step, t_s and the state; failed objects have none."""
    zipped = F.arrays_zip(*(F.col(c) for c in ("px", "py", "pz", "vx", "vy", "vz")))
    rows = eph.filter(F.col("error").isNull()).select("norad_id", "frame", F.posexplode(zipped).alias("step", "s"))
    return rows.select("norad_id", "frame", "step", (start_s + F.col("step") * float(step_s)).alias("t_s"), *(F.col(f"s.{c}").alias(n) for c, n in zip(("px", "py", "pz", "vx", "vy", "vz"), STATE, strict=True)))


def perigee_passages(states: DataFrame, at: str = "t_s") -> DataFrame:
    """When each object's distance from the Earth's centre is least (its radial speed rises through zero): norad_id, at and since, an anomalistic period."""
    radial = (F.col("x") * F.col("vx") + F.col("y") * F.col("vy") + F.col("z") * F.col("vz")) / F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return rising_crossings(states, "norad_id", at, radial)


def node_passages(states: DataFrame, at: str = "t_s") -> DataFrame:
    """When each object goes up through the equator's plane: norad_id, at and since, a nodal period."""
    return rising_crossings(states, "norad_id", at, F.col("z"))


def circle_node_passages(objects: DataFrame, hours: float, step_s: int) -> DataFrame:
    """node_passages of funnel.circular_states, each object's found in its own row, without a row for each sample.

    objects: one orbit for each norad_id; equal rows count once.
    """
    n = int(hours * 3600 // step_s)
    if n < 1 or step_s <= 0:
        raise ValueError("the window must hold two samples at least")
    turn = lambda c: F.col(c) * F.pi() / 180
    orbits = with_motion(objects).select("norad_id", "r", "n", turn("u0_deg").alias("u0"), F.sin(turn("inclination_deg")).alias("si")).filter("r * n * u0 * si is not null").distinct()
    sample = lambda step: F.struct((step * float(step_s)).alias("at"), (F.col("r") * F.sin(F.col("u0") + F.col("n") * (step * step_s)) * F.col("si")).alias("value"))
    series = F.transform(F.sequence(F.lit(0), F.lit(n)), sample)
    return orbits.select("norad_id", F.inline(crossings_in_row(series)))


class _Ephemeris:
    """Rows of one element set's ephemeris; one row that says why if an argument is missing or the propagation fails."""

    def eval(self, mean_motion: float, eccentricity: float, inclination_deg: float, raan_deg: float, arg_perigee_deg: float, mean_anomaly_deg: float, bstar: float, epoch_s: float, start_s: float, hours: float, step_s: int) -> Iterator[tuple]:
        args = (mean_motion, eccentricity, inclination_deg, raan_deg, arg_perigee_deg, mean_anomaly_deg, bstar, epoch_s, start_s, hours, step_s)
        if any(x is None or not np.isfinite(float(x)) for x in args) or step_s <= 0 or hours < 0:
            yield (None, None, *[None] * 6, "missing or wrong argument")
            return
        el, n = sgp4.elements(*map(float, args[:8])), int(float(hours) * 3600 // step_s) + 1
        for k in range(0, n, SAMPLES_AT_ONCE):
            steps = np.arange(k, min(n, k + SAMPLES_AT_ONCE))
            times = float(start_s) + steps * float(step_s)
            p, v, code = sgp4.propagate(el, (times - float(epoch_s)) / 60)
            for i, t, x, y, bad in zip(steps.tolist(), times.tolist(), p.tolist(), v.tolist(), code.tolist(), strict=True):
                yield (i, t, *[None] * 6, sgp4.ERRORS[bad]) if bad else (i, t, *x, *y, None)


def register_functions(spark: SparkSession, name: str = "ephemeris") -> None:
    """Put the table function into SQL: LATERAL ephemeris(mean_motion, eccentricity, inclination_deg, raan_deg, arg_perigee_deg, mean_anomaly_deg, bstar, epoch_s, start_s, hours, step_s).

    It gives step, t_s, the TEME state and error of each sample, so a query
    takes the elements from any table, and the window from its rows.
    """
    spark.udtf.register(name, udtf(_Ephemeris, returnType="step int, t_s double, " + ", ".join(f"{c} double" for c in STATE) + ", error string", useArrow=True))
