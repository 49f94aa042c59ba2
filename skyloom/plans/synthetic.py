"""A synthetic catalogue from integer arithmetic over the star-schema tables, for queries both engines can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys(spark: SparkSession, sf_dir: str, source: str = "supplier") -> DataFrame:
    return table(spark, sf_dir, source).select(F.col("s_suppkey" if source == "supplier" else "c_custkey").alias("k"))


def name_of(k: str = "k") -> F.Column:
    return F.expr(f"CASE {k} % 5 WHEN 0 THEN concat('STARLINK-', {k}) WHEN 1 THEN concat('ONEWEB-', {k}) WHEN 2 THEN concat('COSMOS ', {k}, ' DEB') WHEN 3 THEN concat('SL-', {k}, ' R/B') ELSE concat('SAT ', {k}) END")


def objects(spark: SparkSession, sf_dir: str, source: str = "supplier") -> DataFrame:
    """Catalogue rows with the angles of circular orbits."""
    rows = keys(spark, sf_dir, source).selectExpr(
        "k",
        "CAST(10000 + k AS INT) AS norad_id",
        "CAST(300 + (37 * k) % 900 AS DOUBLE) AS perigee_km",
        "CAST(300 + (37 * k) % 900 + (53 * k) % 250 AS DOUBLE) AS apogee_km",
        "CAST((7 * k) % 181 AS DOUBLE) AS inclination_deg",
        "CAST((29 * k) % 360 AS DOUBLE) AS raan_deg",
        "CAST((83 * k) % 360 AS DOUBLE) AS u0_deg",
        f"timestamp_seconds(unix_timestamp(TIMESTAMP'{NOW}') - 3600 * ((13 * k) % 300)) AS epoch",
        "CASE k % 4 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LARGE' ELSE 'UNKNOWN' END AS rcs_size",
    )
    return rows.withColumn("name", name_of())


def records(spark: SparkSession, sf_dir: str, source: str = "supplier") -> DataFrame:
    """Three-line records built from integers; each 11th has a bad checksum, each 13th a malformed eccentricity."""
    day = "lpad(CAST(1 + (13 * k) % 365 AS STRING), 3, '0')"
    one = f"concat('1 ', CAST(10000 + k AS STRING), 'U 24001A   ', CASE WHEN k % 7 = 0 THEN '98' ELSE '23' END, {day}, '.', lpad(CAST((7919 * k) % 100000000 AS STRING), 8, '0'), '  .00001234  00000-0 ', CASE WHEN k % 3 = 0 THEN '-' ELSE ' ' END, CAST(10000 + (37 * k) % 90000 AS STRING), '-4 0  999')"
    ecc = "CASE WHEN k % 13 = 0 THEN '00A0' ELSE '0000' END"
    two = f"concat('2 ', CAST(10000 + k AS STRING), ' ', lpad(CAST((7 * k) % 181 AS STRING), 3, ' '), '.2500 ', lpad(CAST((29 * k) % 360 AS STRING), 3, ' '), '.5000 ', {ecc}, lpad(CAST((131 * k) % 900 AS STRING), 3, '0'), ' ', lpad(CAST((11 * k) % 360 AS STRING), 3, ' '), '.1250 ', lpad(CAST((83 * k) % 360 AS STRING), 3, ' '), '.7500 ', CAST(11 + k % 5 AS STRING), '.', lpad(CAST((104729 * k) % 100000000 AS STRING), 8, '0'), lpad(CAST(k % 100000 AS STRING), 5, ' '))"
    rows = keys(spark, sf_dir, source).withColumn("name", F.concat(F.lit("0 "), name_of())).selectExpr("k", "name", f"{one} AS body1", f"{two} AS body2")
    from skyloom.functions.tle import checksum

    off = F.when(F.col("k") % 11 == 0, 1).otherwise(0)
    return rows.select(
        "k",
        "name",
        F.concat("body1", ((checksum(F.col("body1")) + off) % 10).cast("string")).alias("line1"),
        F.concat("body2", checksum(F.col("body2")).cast("string")).alias("line2"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approaches from lineitem: miss, speed and radius from its measures, ids from its keys."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 100 + l_linenumber AS event_no",
        "CAST(10000 + l_suppkey AS INT) AS primary_norad_id",
        "CAST(10000 + l_partkey % 120 AS INT) AS secondary_norad_id",
        "CAST(l_shipdate AS TIMESTAMP) AS tca",
        "(l_discount + 0.0D) * 100.0D AS miss_distance_km",
        "l_quantity * 0.3D AS relative_velocity_km_s",
        "(l_tax + 0.0D) * 1000.0D AS combined_radius_m",
        "CAST(l_quantity * 7 AS DOUBLE) AS max_epoch_age_hours",
        "CAST(300 + (37 * l_suppkey) % 900 AS DOUBLE) AS min_perigee_km",
    )
