"""The place of every row in its group, without a sort in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import saved


def runs_before(held: DataFrame, total: Column, add=F.sum) -> DataFrame:
    """What the rows of a group in earlier partitions add up to, per partition ``_part``.

    ``held`` is sorted by group within partitions that are ranges of groups: ``_g`` names the
    group, ``_i`` is the row of the partition.  Only the first group of a partition can have
    rows in earlier ones.  ``total`` is taken from the last row of a partition.  One row
    ``_part, _g, _before`` per partition whose first group began earlier: bounded by the
    number of partitions, not by the data.
    """
    ends = held.groupBy("_part").agg(
        F.min_by("_g", "_i").alias("_g"),
        F.max_by(F.struct(F.col("_g").alias("g"), total.alias("total")), "_i").alias("_last"),
    )
    order = Window.orderBy("_part")
    sums = ends.withColumn("_sum", add("_last.total").over(Window.partitionBy("_last.g").orderBy("_part")))
    return (
        sums.withColumns({"_up_to": F.lag("_sum").over(order), "_from": F.lag("_last.g").over(order)})
        .where("_from = _g")
        .select("_part", "_g", F.col("_up_to").alias("_before"))
    )


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "at") -> DataFrame:
    """``df`` with the place 0, 1, 2 … of every row in its group (null groups are groups, null first).

    Rows are dealt by ranges of group and order, so a group with a third of all rows takes a
    third of the tasks.  Rows equal in all order columns get places in any order.  The sorted
    ranges are written to the shared folder and read again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumn("_g", F.xxhash64(*group) if group else F.lit(0).cast("long"))
    dealt = named.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    dealt = dealt.withColumn("_part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, row = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("_g").to_numpy()
            at = np.arange(len(g))
            new = np.concatenate([[last is None or g[0] != last], g[1:] != g[:-1]])
            begin = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(begin < 0, at + seen, at - begin)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64()), pa.array(row + at, pa.int64())],
                names=[*batch.schema.names, "_place", "_i"],
            )
            last, seen, row = g[-1], int(place[-1]) + 1, row + len(g)

    schema = StructType([*dealt.schema.fields]).add("_place", "long").add("_i", "long")
    held = saved(dealt.mapInArrow(number, schema), "places")
    before = runs_before(held, F.col("_place") + 1)
    return (
        held.join(F.broadcast(before), ["_part", "_g"], "left")
        .withColumn(name, F.col("_place") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_g", "_i", "_place", "_before")
    )
