"""Tests and bins that follow the data: correlation with its p-value, histograms with round breaks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Z_95 = 1.959963984540054


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):  # converges fast on the other side only
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny, front = 1e-300, math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), tiny)
    value = d
    for m in range(1, 10_000):
        for top in (m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * x * d
            c = 1 + top * x / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def two_sided_p(r: float, n: int) -> float | None:
    """Probability of a correlation as far from 0 as ``r`` in ``n`` unrelated pairs; None below three pairs."""
    if n < 3 or r is None or math.isnan(r):
        return None
    df, rest = n - 2, max(0.0, 1 - r * r)  # t * t = r * r * df / rest
    return incomplete_beta(df / 2, 0.5, rest)


@F.pandas_udf(DoubleType())
def _p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([two_sided_p(None if pd.isna(a) else float(a), int(b)) for a, b in zip(r, n)], dtype="float64")


def correlations(df: DataFrame, pairs: list[tuple[str, str]], subsets: dict[str, Column | None]) -> DataFrame:
    """Product-moment correlation tests of all pairs of columns in all subsets, in one pass over ``df``.

    One row ``subset, x, y, n, r, t, df, p, ci_low, ci_high`` per pair and subset (None: all rows).  Rows in which either value
    is NULL do not count.  r is NULL for a constant column, p below three pairs, t where |r| = 1, the interval below four pairs
    or where |r| = 1.
    """
    cells, one = [], []
    for i, (name, keep) in enumerate(subsets.items()):
        for j, (x, y) in enumerate(pairs):
            known = F.col(x).isNotNull() & F.col(y).isNotNull()
            known = known if keep is None else known & keep
            a, b = F.when(known, F.col(x).cast("double")), F.when(known, F.col(y).cast("double"))
            tag = f"{i}_{j}"
            cells += [
                F.count(F.when(known, 1)).alias(f"n{tag}"), F.covar_pop(a, b).alias(f"s{tag}"),
                F.stddev_pop(a).alias(f"u{tag}"), F.stddev_pop(b).alias(f"v{tag}"),
                F.min(a).alias(f"a{tag}"), F.max(a).alias(f"b{tag}"), F.min(b).alias(f"c{tag}"), F.max(b).alias(f"d{tag}"),
            ]
            varies = (F.col(f"a{tag}") < F.col(f"b{tag}")) & (F.col(f"c{tag}") < F.col(f"d{tag}"))
            r = F.try_divide(F.col(f"s{tag}"), F.col(f"u{tag}") * F.col(f"v{tag}"))
            one.append(F.struct(
                F.lit(name).alias("subset"), F.lit(x).alias("x"), F.lit(y).alias("y"),
                F.col(f"n{tag}").alias("n"), F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"),
            ))
    rows = df.agg(*cells).select(F.inline(F.array(*one)))
    z, half = F.atanh("r"), F.try_divide(F.lit(Z_95), F.sqrt(F.when(F.col("n") > 3, F.col("n") - 3)))
    inside = F.abs("r") < 1
    return rows.select(
        "subset", "x", "y", "n", "r",
        F.when(inside & (F.col("n") > 2), F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))).alias("t"),
        (F.col("n") - 2).alias("df"), _p("r", "n").alias("p"),
        F.when(inside, F.tanh(z - half)).alias("ci_low"), F.when(inside, F.tanh(z + half)).alias("ci_high"),
    )


def histogram_breaks(df: DataFrame, column: str, breaks: int | None = None) -> DataFrame:
    """``lower, upper, n`` of bins with round limits over the range of the column; bins hold their upper end, the first both.

    About ``breaks`` bins; by default as many as the logarithm of the number of rows asks for (Sturges).  Widths are 1, 2 or 5
    times a power of ten.  Empty bins are listed.  NULL and NaN do not count.  A constant column has one bin of width 1
    that ends at or after it; no values give no bins.  Two passes, of which the first returns one row and the
    second one row per bin.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    wanted = F.lit(float(breaks)) if breaks else F.ceil(F.log2("n") + 1)
    plan = (
        values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).where("n > 0")
        .withColumn("bins", wanted.cast("double"))
        .withColumn("raw", F.expr("if(high > low, (high - low) / bins, 1D)"))
        .withColumn("base", F.expr("pow(10D, floor(log10(raw)))"))
        # fixed values: from these ratios on the next round width is taken
        .withColumn("width", F.expr("""base * CASE WHEN raw > base * 7 THEN 10 WHEN raw > base * 2.8D THEN 5
            WHEN raw > base * 1.4D THEN 2 ELSE 1 END"""))
        .selectExpr(
            "width", "CAST(if(high > low, floor(low / width + 1e-7), ceil(low / width) - 1) AS BIGINT) AS first",
            "CAST(ceil(high / width - 1e-7) AS BIGINT) AS last",
        )
    )
    plan = plan.withColumn("last", F.greatest("last", F.col("first") + 1))
    counts = (
        values.crossJoin(F.broadcast(plan))  # one row
        .selectExpr("greatest(CAST(ceil(v / width - 1e-7) AS BIGINT), first + 1) AS k")
        .groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    )
    bins = plan.selectExpr("width", "explode(sequence(first + 1, last)) AS k")
    return bins.join(counts, "k", "left").selectExpr("(k - 1) * width AS lower", "k * width AS upper", "coalesce(n, 0L) AS n")


def scatter_data(df: DataFrame, x: str, y: str, x_limits: tuple[float, float] | None = None, y_limits: tuple[float, float] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``x, y`` and columns ``keep`` of the rows that a scatter plot with these limits (both included) would show."""
    shown = df.select(*keep, F.col(x).alias("x"), F.col(y).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    for axis, limits in (("x", x_limits), ("y", y_limits)):
        if limits:
            shown = shown.where(F.col(axis).between(*map(float, limits)))
    return shown
