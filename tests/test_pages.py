"""Pages of an ordered table: each row once, only the files that hold a page, totals without a scan."""

import pytest
from pyspark.sql import functions as F

from skyloom.sources import pages

SCHEMA = "tca timestamp, event_id string, risk double"


def events(spark, n):
    """n events; many share a time, some have neither time nor id, each 50th comes twice."""
    rows = spark.range(n).select(F.when(F.col("id") % 97 != 0, F.timestamp_seconds(F.col("id") * 7919 % 400)).alias("tca"), F.when(F.col("id") % 101 != 0, F.concat(F.lit("e"), F.col("id"))).alias("event_id"), (F.col("id") % 13 / 13).alias("risk"))
    return rows.union(rows.filter("event_id LIKE '%50'"))


def key(r):
    return (r.tca is not None, r.tca or 0, r.event_id is not None, r.event_id or "")


def test_pages_are_the_whole_table_in_order(spark, tmp_path):
    path, rows = str(tmp_path / "t"), events(spark, 3000)
    pages.write_pages(rows, path, rows_per_file=64)
    want = sorted(rows.collect(), key=key)
    got = [r for k in range(0, len(want) + 500, 170) for r in pages.read_page(spark, path, rows.schema, limit=170, offset=k).collect()]
    assert [key(r) for r in got] == [key(r) for r in want] and sorted(map(str, got)) == sorted(map(str, want))
    assert pages.total(spark, path).first().n == len(want)


def test_a_deep_page_reads_what_holds_it(spark, tmp_path):
    path, rows = str(tmp_path / "t"), events(spark, 4000)
    pages.write_pages(rows, path, rows_per_file=100)
    page = pages.read_page(spark, path, rows.schema, limit=50, offset=3000)
    assert len(page.inputFiles()) <= 3 < 40 <= len(spark.read.parquet(f"{path}/files").collect())
    assert [key(r) for r in page.collect()] == [key(r) for r in sorted(rows.collect(), key=key)[3000:3050]]


def test_odd_tables_and_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    pages.write_pages(spark.createDataFrame([], SCHEMA), path)
    assert pages.total(spark, path).first().n == 0 and pages.read_page(spark, path, SCHEMA).count() == 0
    same = str(tmp_path / "same")  # one row many times over
    pages.write_pages(spark.range(300).select(F.timestamp_seconds(F.lit(1)).alias("tca"), F.lit("e").alias("event_id"), F.lit(0.5).alias("risk")), same, rows_per_file=50)
    assert [pages.read_page(spark, same, SCHEMA, limit=120, offset=k).count() for k in (0, 120, 240, 300)] == [120, 120, 60, 0]
    for wrong in ({"limit": 501}, {"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            pages.read_page(spark, same, SCHEMA, **wrong)
    with pytest.raises(Exception, match="(?i)exists"):
        pages.write_pages(spark.createDataFrame([], SCHEMA), same)
