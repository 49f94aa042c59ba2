"""Mixing sources to target weights by entropy balancing.

A document of s words is taken at a rate w. Of all rates, those are sought
that are nearest to taking each document once - in relative entropy, the sum
of w log w - w over the documents - while each source's words, the sum of
w * s, meet the source's target and no rate is above MOST_COPIES. The convex
dual has one multiplier a source, and the rates are
``min(most, exp(multiplier * s))``: exponentially tilted, by the document's own
size, so a source that is cut down loses its longest documents first and one
that is raised repeats them first, until the cap holds them.

Newton's method finds the multipliers. Each step is an aggregation over the
distributed table of (source, size, documents): the words and their
derivative at the present multipliers, summed as decimals, so that no result
depends on the order in which rows arrive. A source's step that leaves the
bracket of its earlier steps is replaced by the bracket's middle, and after
NEWTON_STEPS all are, until each source meets its target or its bracket is as
narrow as numbers allow.

Rates become copies bucket by bucket: a source's documents are dealt into
buckets by a hash of all their values, and in each the largest document is
rounded first and the rest carries the error on. A bucket is read as a stream.

Defined cases: a null text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; rows that repeat a doc_id, or all values,
count and are rounded each on their own (equal rows may get different numbers
of copies); rows without doc_id are like others; documents of one size share a
rate, and ties are rounded by doc_id; with no words at all every target is 0;
an empty table gives an empty result; extra columns of any name are ignored
(mix_rows keeps them).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import words
from skyloom.llm.common import map_batches, materialise, partitions, slices, unused, utf8

#: No document is taken more often.
MOST_COPIES = 3
#: Documents of one rounding bucket, about.
GROUP_ROWS = 4_000
#: Steps after which brackets are only halved, and the relative error of a source's words at which steps end.
NEWTON_STEPS = 60
CLOSE = 1e-6
WEIGHTS = (5.0, 2.0, 1.0)


def with_sizes(docs: DataFrame, name: str) -> DataFrame:
    """docs and one more column: the words of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                count = words.split(*utf8(part.column("text")), ~words.SPACES).count
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(count, pa.int64())], [*part.schema.names, name])

    return map_batches(docs, run, docs.select("*", F.lit(0).cast("long").alias(name)).schema)


def in_order(stats: DataFrame) -> DataFrame:
    """The sources with their place in code point order, null last, counted over range partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows), pa.int64())], [*batch.schema.names, "at"])
            at += batch.num_rows

    order = F.asc_nulls_last("source")
    dealt = stats.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    placed = materialise(map_batches(dealt, run, "source string, source_size long, n_docs long, part int, at long"), "sources")
    counts = {r.part: r.n for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    known = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.lit(None).cast("map<int,int>")
    return placed.withColumn("place", F.col("at") + known[F.col("part")]).drop("part", "at")


def source_targets(counted: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs and target of each source.

    Weights repeat over the sources in code point order, null last, and share
    all words; a source stops at most times its own, and the excess is shared
    by weight among the others: one aggregation finds which stop at the present
    level, until none is added.
    """
    stats = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n_docs"))
    placed = in_order(stats)
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed, cap = placed.withColumn("weight", weight), F.col("source_size") * float(most)
    level = 0.0  # words for each unit of weight
    while True:
        stop = F.col("weight") * level > cap
        total, held, open_ = placed.agg(F.sum("source_size"), F.sum(F.when(stop, cap)), F.sum(F.when(~stop, F.col("weight")))).first()
        higher = ((total or 0) - (held or 0)) / open_ if open_ else level
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return placed.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, cap).alias("target"))


def multipliers(counted: DataFrame, targets: DataFrame, most: float = MOST_COPIES) -> DataFrame:
    """targets with tilt (multiplier times unit words) and unit, the size of the document that a source's typical word stands in.

    A null tilt means a rate that is the same for all its documents: most
    where the target is most times the source, 0 where there are no words.
    """
    unit = counted.groupBy("source").agg(F.try_divide(F.sum(F.col("size") * F.col("size") * F.col("docs")), F.sum(F.col("size") * F.col("docs"))).alias("unit"))
    start = F.when((F.col("target") > 0) & (F.col("target") < F.col("source_size") * float(most) * (1 - CLOSE)), F.log(F.try_divide("target", "source_size")))
    state = targets.join(unit.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    state = materialise(state.withColumns({"tilt": start, "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "error": F.lit(None).cast("double")}), "tilts")
    tilted = F.exp(F.least(F.col("tilt") * F.try_divide("size", "unit"), F.lit(60.0)))
    free = tilted < float(most)
    exact = lambda x: F.sum(x.cast("decimal(28,9)")).cast("double")
    wide = (F.abs("error") > CLOSE) & (F.col("low").isNull() | F.col("high").isNull() | (F.col("high") - F.col("low") > 1e-15 * (1 + F.abs("tilt"))))
    for step in itertools.count():
        moving = state.filter("tilt IS NOT NULL").select(F.col("source").alias("of"), "tilt", "unit")
        at = counted.join(moving, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(
            exact(F.least(tilted, F.lit(float(most))) * F.col("size") * F.col("docs")).alias("got"),
            exact(F.when(free, tilted * F.col("size") * F.try_divide("size", "unit") * F.col("docs")).otherwise(0.0)).alias("slope"),
        )
        state = state.drop("error").join(at, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        state = state.withColumn("error", F.try_divide(F.col("got") - F.col("target"), F.col("target")))
        state = state.withColumns({"low": F.when(F.col("error") < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(F.col("error") >= 0, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") - F.try_divide(F.col("error") * F.col("target"), F.col("slope"))
        inside = F.lit(step < NEWTON_STEPS) & F.col("slope").isNotNull() & (F.col("slope") > 0) & (newton > F.coalesce("low", F.col("tilt") - 4)) & (newton < F.coalesce("high", F.col("tilt") + 4))
        middle = (F.coalesce("low", F.col("high") - 4) + F.coalesce("high", F.col("low") + 4)) / 2
        state = state.withColumn("tilt", F.when(F.abs("error") <= CLOSE, F.col("tilt")).otherwise(F.when(inside, newton).otherwise(middle))).drop("got", "slope")
        state = materialise(state, "tilts")
        if state.filter(wide).isEmpty():
            break
    return state.select("source", "source_size", "n_docs", "target", "unit", "tilt")


def mix_rows(docs: DataFrame, keep: list[str], names: dict[str, str], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """All rows of docs with the columns in keep, and size, source_size, target, rate and copies under the names given for them."""
    size, source = names["size"], F.col("source").cast("string")
    plain = with_sizes(docs.select(F.col("source").cast("string").alias("source"), "text"), "size")
    counted = materialise(plain.groupBy("source", "size").agg(F.count("*").alias("docs")), "sizes")
    tilts = multipliers(counted, source_targets(counted, weights, most), most)
    of = {c: unused(docs, c + "_of") for c in ("source", "n_docs", "unit", "tilt")}
    known = tilts.select(*(F.col(c).alias(of[c]) for c in of), *(F.col(c).alias(names[c]) for c in ("source_size", "target")))
    rated = with_sizes(docs, size).join(known, source.eqNullSafe(F.col(of["source"])))
    tilted = F.least(F.exp(F.least(F.col(of["tilt"]) * F.try_divide(F.col(size), F.col(of["unit"])), F.lit(60.0))), F.lit(float(most)))
    rate = F.when((F.col(size) > 0) & (F.col(names["target"]) > 0), F.coalesce(tilted, F.lit(float(most)))).otherwise(0.0)
    mark, bucket = unused(docs, "mark_of"), unused(docs, "bucket_of")
    rated = rated.withColumn(names["rate"], rate).withColumn(mark, F.xxhash64("doc_id", "text"))
    rated = rated.withColumn(bucket, F.pmod(F.col(mark), F.ceil(F.col(of["n_docs"]) / GROUP_ROWS)))
    keys = [of["source"], bucket]
    out_names = [*keep, *(names[c] for c in ("size", "source_size", "target", "rate"))]
    dealt = rated.select(*dict.fromkeys([*out_names, "doc_id", mark, *keys])).repartition(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys, F.desc(size), "doc_id", mark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, over = None, 0.0  # the words taken too few (or, below 0, too many) so far in the open bucket
        for batch in batches:
            copies = []
            group = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
            for key, n, want in zip(group, *(batch.column(names[c]).to_pylist() for c in ("size", "rate")), strict=True):
                if key != opened:
                    opened, over = key, 0.0
                k = min(most, max(0, round((want * n + over) / n))) if n else 0
                over += want * n - k * n
                copies.append(k)
            if copies:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out_names), pa.array(copies, pa.int32())], [*out_names, names["copies"]])

    schema = dealt.select(*out_names, F.lit(0).alias(names["copies"])).schema
    return map_batches(dealt, run, schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """How often the mix takes each document.

    Returns doc_id, source, size, source_size, target, rate, copies and
    taken = copies * size, one row for each row of docs.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    names = {c: c for c in ("size", "source_size", "target", "rate", "copies")}
    return mix_rows(given, ["doc_id", "source"], names, weights, most).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of docs as often as the mix takes them."""
    names = {c: unused(docs, "mix_" + c) for c in ("size", "source_size", "target", "rate", "copies")}
    rows = mix_rows(docs, docs.columns, names, weights, most).filter(F.col(names["copies"]) > 0)
    each = F.explode(F.sequence(F.lit(1), F.col(names["copies"])))
    return rows.select(*docs.columns, each.alias(unused(docs, "copy_of"))).select(*docs.columns)
