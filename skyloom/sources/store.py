"""Upserts and loads over plain tables: each returns the table's new content as a DataFrame."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.operators.events import missing_references
from skyloom.schemas import CATALOG_SCHEMA, EVENT_SCHEMA, RUN_SCHEMA

TABLES = {"objects": CATALOG_SCHEMA, "screening_runs": RUN_SCHEMA, "conjunctions": EVENT_SCHEMA}


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below spark.checkpoint.dir, which driver and executors share; without it, and on this machine only, in the temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "skyloom-checkpoints")
    return f"{where.rstrip('/')}/skyloom/{name}-{uuid.uuid4().hex}"


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """current with incoming rows put in by key; of several incoming rows the last by order wins."""
    by = Window.partitionBy(key).orderBy(F.desc(order))
    last = incoming.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n", *([order] if order not in current.columns else []))
    return current.join(last, key, "left_anti").unionByName(last)


#: Folders of a merged table, by a hash of its key.
BUCKETS = 64


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that merge_into keeps; no rows where there is none yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def merge_into(path: str, incoming: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> None:
    """Put rows into the stored table by key: a row of a known key replaces it, of several incoming ones the last by order wins.

    The table lies in folders by a hash of the key. Only the folders that
    incoming rows fall into are read and written anew (dynamic partition
    overwrite), so a merge costs what it touches; merging the same rows again
    changes nothing. One writer at a time.
    """
    spark, schema = incoming.sparkSession, incoming.schema
    part = (F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")
    touched = [r.bucket for r in incoming.select(part.alias("bucket")).distinct().collect()]  # at most `buckets` numbers
    if not touched:
        return
    known = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    current = read_table(spark, path, known).filter(F.col("bucket").isin(touched)).drop("bucket")
    merged = upsert(current, incoming, key, order).withColumn("bucket", part)
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_run(runs: DataFrame, run: DataFrame, within_s: float = 1.0) -> DataFrame:
    """runs with one run put in: it replaces the counters of a run that started within a second, or is new.

    The start is matched on whole seconds and their neighbours, an equi-join.
    """
    keyed = runs.withColumn("_sec", F.floor(F.unix_micros("started_at") / 1_000_000))
    near = run.withColumn("_sec", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.unix_micros("started_at") / 1_000_000) + d)))
    new = near.select("_sec", *(F.col(c).alias(f"n_{c}") for c in run.columns))
    apart = F.abs(F.unix_micros("started_at") - F.unix_micros("n_started_at"))
    hits = keyed.join(new, "_sec").filter(apart < within_s * 1e6)
    hit = hits.orderBy(apart, "id").limit(1)
    others = [c for c in run.columns if c not in ("id", "started_at")]
    updated = hit.select("id", "started_at", *(F.coalesce(f"n_{c}", c).alias(c) for c in others)).select(*runs.columns)
    added = run.join(hit.select(F.col("n_started_at").alias("started_at")), "started_at", "left_anti").select(*runs.columns)
    return runs.join(updated.select("id"), "id", "left_anti").unionByName(updated).unionByName(added)


def check_references(events: DataFrame, objects: DataFrame) -> None:
    """Raise if events name objects that are not there; the message has the first ten."""
    missing = [r.norad_id for r in missing_references(events, objects).orderBy("norad_id").limit(10).collect()]
    if missing:
        raise ValueError(f"events reference unknown objects: {missing}")


def create_tables(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/{name}")


def migrate_events(events: DataFrame) -> DataFrame:
    """Older events get the constellation flag, false."""
    if "intra_constellation" not in events.columns:
        events = events.withColumn("intra_constellation", F.lit(False))
    return events.na.fill({"intra_constellation": False})


def publish(events: DataFrame, send) -> None:
    """Send each event's JSON, at most once, from the tasks; a failing sender is ignored."""

    def each(rows):
        for row in rows:
            try:
                send(row.value)
            except Exception:  # noqa: BLE001 - delivery is at most once by contract
                continue

    events.select(F.to_json(F.struct("*")).alias("value")).foreachPartition(each)
