"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import shuffled

# A key is hot when one side holds more rows of it than this, however large the tables are.
HOT_ROWS = 20_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join in which every hot key is spread over many tasks, whichever side is hot, or both.

    Rows of a hot key are dealt into ``n`` parts on the one side and ``m`` on the other, and repeated for every part of the
    other side, so that each pair meets once, in one of ``n * m`` tasks.  Nothing is dropped; keys that are not hot have one part.
    Both sides are read twice; they should be written tables.
    """
    counts = [side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)) for side, name in ((left, "_n"), (right, "_m"))]
    parts = lambda c: F.ceil(F.col(c) / F.lit(float(hot_rows))).cast("int").alias(c)
    both = counts[0].join(shuffled(counts[1]), keys)
    hot = both.where((F.col("_n") > hot_rows) | (F.col("_m") > hot_rows)).select(*keys, parts("_n"), parts("_m"))

    def dealt(side: DataFrame, own: str, other: str, own_salt: str, other_salt: str) -> DataFrame:
        one = F.coalesce(F.col(own), F.lit(1))
        return (
            # rows of a written table keep their numbers; equal rows must not go to the same part
            side.withColumn("_row", F.monotonically_increasing_id())
            .join(hot, keys, "left")
            .withColumn(own_salt, F.pmod(F.xxhash64("_row"), one).cast("int"))
            .withColumn(other_salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("_n", "_m", "_row")
        )

    a, b = dealt(left, "_n", "_m", "_s", "_t"), dealt(right, "_m", "_n", "_t", "_s")
    return a.join(shuffled(b), [*keys, "_s", "_t"]).drop("_s", "_t")
