import pytest

from bocage.operators.tables import with_row_number


@pytest.mark.parametrize(
    "keys", [[2, None, 5], ["b", "a", None, "é"], [*range(50), 10**15], []], ids=["null", "text", "outlier", "empty"]
)
def test_row_numbers(spark, keys):
    kind = "string" if "b" in keys else "long"
    got = with_row_number(spark.createDataFrame([(k,) for k in keys], f"k {kind}"), ["k"], "no").collect()
    want = sorted(keys, key=lambda k: (k is not None, k))
    assert {r.k: r.no for r in got} == {k: i + 1 for i, k in enumerate(want)}


def test_outlier_does_not_fill_one_range(spark):
    df = spark.range(4000).selectExpr("IF(id = 0, 1000000000000, id) AS k")
    got = with_row_number(df, ["k"], "no", 8)
    assert got.selectExpr("min(no)", "max(no)", "count(DISTINCT no)").first()[:] == (1, 4000, 4000)
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2000
