"""Snapshot files of catalogue text: landing, listing, newest, and loading under a freshness policy."""

from __future__ import annotations

import logging
import os
import tempfile
import time
import urllib.error
import urllib.request
from datetime import datetime, timedelta, timezone
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.constants import CACHE_HOURS
from skyloom.functions import tle
from skyloom.operators.catalog import build_objects, first_of, is_diagnostic, split_records

NAME = r"^(.+)_([0-9]{8}T[0-9]{6}Z)\.tle$"
STAMP = "%Y%m%dT%H%M%SZ"
USER_AGENT = "skyloom/1.0 (catalogue screening; batch refresh)"
RETRY_STATUS = (500, 502, 503, 504)
#: Characters of a body that are looked at for a server's message.
SNIFFED = 4096


def parse_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Adds grp and fetched_at from a file name, split at the last underscore; misnamed files drop out."""
    stamp = F.regexp_extract(name, NAME, 2)
    at = F.try_to_timestamp(stamp, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return files.filter(F.col(name).rlike(NAME)).withColumns({"grp": F.regexp_extract(name, NAME, 1), "fetched_at": at}).filter(F.col("fetched_at").isNotNull())


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshots of a folder: path, file_name, raw, grp, fetched_at, oldest first; a missing folder is empty."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return spark.createDataFrame([], "path string, file_name string, raw string, grp string, fetched_at timestamp")
    files = spark.read.option("pathGlobFilter", "*.tle").text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("raw"))
    return parse_names(files).orderBy("fetched_at")


def newest(files: DataFrame) -> DataFrame:
    """The newest snapshot of each group."""
    return files.groupBy("grp").agg(F.max_by(F.struct(*[c for c in files.columns if c != "grp"]), F.struct("fetched_at", "file_name")).alias("s")).select("grp", "s.*")


def group_url(base: str, group: str) -> str:
    return f"{base}?{urlencode({'GROUP': group, 'FORMAT': 'tle'})}"


def fetch(url: str, dest: str, retries: int = 3, timeout_s: float = 120.0, backoff: float = 2.0, opener=urllib.request.urlopen) -> str:
    """Land one catalogue on the driver: to a .part file, renamed when whole. Server errors are tried again, 4xx are not."""
    for attempt in range(retries + 1):
        try:
            request = urllib.request.Request(url, headers={"User-Agent": USER_AGENT})
            with opener(request, timeout=timeout_s) as body, open(f"{dest}.part", "wb") as out:
                while chunk := body.read(1 << 16):
                    out.write(chunk)
            os.replace(f"{dest}.part", dest)
            return dest
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUS or attempt == retries:
                raise
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            if attempt == retries:
                raise
        time.sleep(backoff * 2**attempt)
    raise RuntimeError("unreachable")


def land(spark: SparkSession, url: str, dest: str, fetcher=fetch) -> str:
    """Fetch a catalogue and put it at dest, in any store that Spark can write; a server's message instead of one raises and leaves nothing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    with tempfile.TemporaryDirectory() as scratch:
        local = os.path.join(scratch, "body.tle")
        fetcher(url, local)
        with open(local, encoding="utf-8", errors="replace") as body:
            told = spark.createDataFrame([(body.read(SNIFFED),)], "raw string").select(is_diagnostic(F.col("raw"))).first()[0]
        if told:
            raise RuntimeError(f"the server sent a message in place of the catalogue: {url}")
        fs = path(dest).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path(dest).getParent())
        fs.copyFromLocalFile(True, True, path(f"file://{local}"), path(f"{dest}.part"))
        if not fs.rename(path(f"{dest}.part"), path(dest)):
            raise OSError(f"cannot put the catalogue at {dest}")
    return dest


def choose_snapshot(spark: SparkSession, folder: str, group: str, now: datetime, offline: bool = False, base_url: str | None = None, fetcher=fetch) -> tuple[str, bool]:
    """(path, from_cache) of the snapshot to use: under six hours old from the cache, else fetched, else stale.

    A stale one is used, with a warning, where the server cannot be reached or
    fails; its refusal (4xx) and its message in place of a catalogue raise.
    """
    row = snapshots(spark, folder).filter(F.col("grp") == group).orderBy(F.desc("fetched_at")).select("path", "fetched_at").first()
    if offline:
        if row is None:
            raise FileNotFoundError(f"no snapshot of {group} in {folder}")
        return row.path, True
    age = now - row.fetched_at.replace(tzinfo=timezone.utc) if row is not None else None
    if age is not None and age < timedelta(hours=CACHE_HOURS):
        return row.path, True
    try:
        return land(spark, group_url(base_url or "", group), f"{folder.rstrip('/')}/{group}_{now.strftime(STAMP)}.tle", fetcher), False
    except OSError as e:
        if row is None or isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500:
            raise
        logging.getLogger(__name__).warning("catalogue %s could not be fetched (%s); using the snapshot of %.1f hours ago", group, e, age.total_seconds() / 3600)
        return row.path, True  # stale, better than nothing


def load_catalog(spark: SparkSession, path: str, now: Column, rcs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(objects, parsed) of one snapshot file; a server message instead of records raises."""
    raw = spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("raw"))
    raw = raw.withColumn("raw", F.when(is_diagnostic(F.col("raw")), F.raise_error(F.lit("the snapshot is a server message"))).otherwise(F.col("raw")))
    parsed = tle.parse(split_records(raw), now)
    return build_objects(first_of(parsed.filter("parse_error IS NULL"), "norad_id", "rec_no"), rcs), parsed
