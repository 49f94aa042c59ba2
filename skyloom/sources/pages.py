"""Tables kept in an order with the counts of their files, so that a page far down reads only the files that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.operators.events import check_page

#: Rows of a file, at most: a page is at most 500 rows, so it touches two files or, where files are nearly empty, a few.
ROWS_PER_FILE = 50_000


def _whole_row(columns: list[str]) -> Column:
    """What orders rows of one order key: those still tied are equal in all columns, but for a collision of 64 bits."""
    return F.xxhash64(*(F.to_json(F.struct(F.col(c))) for c in columns))


def write_pages(rows: DataFrame, path: str, order: tuple[str, ...] = ("tca", "event_id"), rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write rows in order (nulls first) under path/data, and under path/files each file's name, its number of rows and that before it.

    The second table has a row a file. A path that is there already raises:
    write to a new one and hand its name on.
    """
    if rows_per_file < 1:
        raise ValueError("rows_per_file is 1 or more")
    spark = rows.sparkSession
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/data")
    key = F.struct(*order)
    written = spark.read.schema(rows.schema).parquet(f"{path}/data").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    # files do not overlap but in equal keys, so their ends order them
    before = Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1)
    written.select("file", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/files")


def total(spark: SparkSession, path: str) -> DataFrame:
    """The number of all rows, as a row with n, from the counts of files alone."""
    return spark.read.schema("file string, n long, start long").parquet(f"{path}/files").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def read_page(spark: SparkSession, path: str, schema, order: tuple[str, ...] = ("tca", "event_id"), limit: int = 50, offset: int = 0) -> DataFrame:
    """The rows from offset on, up to limit (500 at most), in order; only files that hold some of them are read.

    Pages of one table do not overlap and leave nothing out, ties included. An
    offset beyond the end gives no rows.
    """
    check_page(limit, offset)
    files = spark.read.schema("file string, n long, start long").parquet(f"{path}/files")
    # at most limit rows lie in them, so they are at most limit files
    held = files.filter((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset) & (F.col("n") > 0)).orderBy("start").collect()
    if not held:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(f"{path}/data/{f.file}" for f in held))
    place = F.create_map(*(x for f in held for x in (F.lit(f.file), F.lit(f.start))))
    placed = rows.withColumns({"_at": F.element_at(place, F.col("_metadata.file_name")), "_tie": _whole_row(rows.columns)})
    return placed.orderBy("_at", *order, "_tie").offset(offset - held[0].start).limit(limit).drop("_at", "_tie")
