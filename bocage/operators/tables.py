"""Relational helpers: joins with clear names, ordered de-duplication, fills, pivots."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


# --- joins ----------------------------------------------------------------------------


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join by shuffle and merge.

    Spark expects of rows that were cut, exploded or read from small files a fraction of their size; it would send
    them whole through the driver to every executor.
    """
    return df.hint("merge")


def rename_clashes(left: DataFrame, right: DataFrame, keys, left_name: str, right_name: str):
    """Give columns both sides have a prefix that says where they come from."""
    clash = [c for c in left.columns if c in right.columns]
    return (
        left.withColumnsRenamed({c: f"{left_name}_{c}" for c in clash if c not in keys}),
        right.withColumnsRenamed({c: f"{right_name}_{c}" for c in clash}),
    )


def merge(
    left: DataFrame,
    right: DataFrame,
    left_on: list[str] | str,
    right_on: list[str] | str | None = None,
    how: str = "inner",
    names: tuple[str, str] = ("left", "right"),
    null_keys_match: bool = True,
) -> DataFrame:
    """Equi-join whose key columns appear once, under the left names.

    NULL keys match each other unless ``null_keys_match`` is off.
    """
    left_on = [left_on] if isinstance(left_on, str) else list(left_on)
    right_on = left_on if right_on is None else [right_on] if isinstance(right_on, str) else list(right_on)
    right = right.withColumnsRenamed({r: f"_key_{i}" for i, r in enumerate(right_on)})
    left, right = rename_clashes(left, right, left_on, *names)
    same = [
        left[k].eqNullSafe(right[f"_key_{i}"]) if null_keys_match else left[k] == right[f"_key_{i}"]
        for i, k in enumerate(left_on)
    ]
    joined = left.join(right, reduce(lambda a, b: a & b, same), how)
    if how in ("right", "full", "outer", "right_outer", "full_outer"):
        key = {k: F.coalesce(F.col(k), F.col(f"_key_{i}")) for i, k in enumerate(left_on)}
        joined = joined.withColumns(key)
    return joined.drop(*[f"_key_{i}" for i in range(len(left_on))])


def natural_merge(left: DataFrame, right: DataFrame, how: str = "inner", **kw) -> DataFrame:
    """Join on every column name the two sides share."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return merge(left, right, shared, how=how, **kw)


# --- unions and distinct --------------------------------------------------------------


def union_by_name(*tables: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of all tables; missing columns become NULL unless ``strict``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), tables)


def in_order(*tables: DataFrame, row_order: str) -> DataFrame:
    """Union that records where each row stood: ``source_no`` then ``row_order``."""
    return union_by_name(
        *[t.withColumn("source_no", F.lit(i)) for i, t in enumerate(tables)]
    ).withColumn("row_no", F.col(row_order))


def first_by_key(df: DataFrame, keys: list[str] | str, order: list[str]) -> DataFrame:
    """Keep the first row of every key in the given order.

    ``min_by`` combines on the map side, so a key with very many rows costs no more than
    one row per task; no window, no sort.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def _checkpointed(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder; a temporary one only where none is set, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="bocage-"))
    return df.checkpoint()


def with_row_number(df: DataFrame, order: list[str], name: str = "id", buckets: int | None = None) -> DataFrame:
    """1, 2, 3 … in the given order (which must be unique; NULL first), without sorting in one task.

    Rows are dealt by ranges of all order columns, at quantiles that Spark samples, so that neither
    an outlier nor a frequent value fills one task.  They are numbered inside their range and
    shifted by the rows of earlier ranges.  The ranges are written down, so that both
    passes see the same ones, also after a lost executor.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # partition in the upper bits, then the row in it
    held = _checkpointed(ranged.withColumn("_at", place))
    numbered = held.select("*", F.shiftright("_at", 33).alias("_b"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_i"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        numbered.groupBy("_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return (
        numbered.join(F.broadcast(shift), "_b")  # at most ``buckets`` rows
        .withColumn(name, F.col("_before") + F.col("_i") + 1)
        .drop("_at", "_b", "_i", "_before")
    )


# --- fills and ratios -----------------------------------------------------------------


def fill_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL and NaN become 0; in text columns ``'0'``."""
    columns = df.columns if columns is None else columns
    out = {}
    for f in df.schema.fields:
        if f.name not in columns:
            continue
        if isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit("0"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.coalesce(F.nanvl(F.col(f.name), F.lit(0.0)), F.lit(0.0))
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
    return df.withColumns(out)


def share(part, whole) -> Column:
    """Percent; 0/0 is 0 and x/0 is NULL."""
    part, whole = (F.col(c) if isinstance(c, str) else c for c in (part, whole))
    return F.when((part == 0) & (whole == 0), F.lit(0.0)).otherwise(
        F.try_divide(part, whole) * 100.0
    )


# --- shape ----------------------------------------------------------------------------


def pivot_sum(
    df: DataFrame,
    keys: list[str],
    names_from: str,
    values_from: str,
    names: dict,
    null_name: str | None = None,
    other_name: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Long to wide with the output columns fixed beforehand by ``names`` (value -> column).

    A value that is absent from the data still gets its column (NULL).  ``null_name`` is the
    column for a NULL value, ``other_name`` the one for all values that are not listed, ``total`` the one for
    the sum of all rows.  Written as conditional sums, which is what a pivot with listed values runs as, in one pass.
    """
    cells = [
        F.sum(F.when(F.col(names_from) == F.lit(value), F.col(values_from))).alias(column)
        for value, column in names.items()
    ]
    if null_name:
        cells.append(F.sum(F.when(F.col(names_from).isNull(), F.col(values_from))).alias(null_name))
    if other_name:
        listed = F.col(names_from).isin(list(names))
        cells.append(F.sum(F.when(~listed, F.col(values_from))).alias(other_name))
    if total:
        cells.append(F.sum(values_from).alias(total))
    return df.groupBy(*keys).agg(*cells)


def add_suffix(df: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    """Append ``suffix`` to every column but the keys."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keys})


# --- aggregates -----------------------------------------------------------------------


def count_by(df: DataFrame, keys: list[str] | str, name: str = "nbre") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_and_sum(df: DataFrame, keys: list[str], value: str, total: str, count: str = "poly_n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), F.sum(value).alias(total))


def group_total(df: DataFrame, key: list[str], value: str, total: str) -> DataFrame:
    """Sum of already grouped rows per coarser key."""
    return df.groupBy(*key).agg(F.sum(value).alias(total))
