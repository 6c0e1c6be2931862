"""Statistics, candidates, exports and indexed layers."""

import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bocage.functions import geometry as g
from bocage.operators import stats, tables
from bocage.plans import selection
from bocage.sources import layers


@pytest.mark.parametrize("r, n, p", [  # from the closed forms of Student's distribution with 1, 2 and 4 degrees of freedom
    (0.5, 3, 1 - 2 / math.pi * math.asin(0.5)), (0.3, 4, 0.7), (-0.3, 4, 0.7), (0.6, 6, 1 - 0.6 * (3 - 0.36) / 2), (0.0, 9, 1.0), (1.0, 3, 0.0), (-1.0, 8, 0.0),
])
def test_p_values(r, n, p):
    assert stats.two_sided_p(r, n) == pytest.approx(p, abs=1e-12)


def test_p_values_against_an_integral():
    for r, n in ((0.12, 30), (0.4, 60), (-0.05, 500), (0.7, 15)):
        df = n - 2
        t = abs(r) * math.sqrt(df / (1 - r * r))
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        steps = 20_000
        h = t / steps
        inner = sum((1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1)) * h / 3
        assert stats.two_sided_p(r, n) == pytest.approx(1 - 2 * c * inner, abs=1e-9)
    assert stats.two_sided_p(0.5, 2) is None and stats.two_sided_p(None, 9) is None


def test_correlations_in_one_pass(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random(), 3.0) for i in range(50)] + [(50, None, 1.0, 3.0), (51, 1.0, None, 3.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double")
    got = {(r.subset, r.x): r for r in stats.correlations(df, [("a", "b"), ("c", "b")], {"all": None, "few": F.col("i") < 3, "two": F.col("i") < 2, "none": F.col("i") < 0}).collect()}
    known = rows[:50]
    ma, mb = (sum(r[k] for r in known) / 50 for k in (1, 2))
    r = sum((x[1] - ma) * (x[2] - mb) for x in known) / math.sqrt(sum((x[1] - ma) ** 2 for x in known) * sum((x[2] - mb) ** 2 for x in known))
    one = got["all", "a"]
    assert (one.n, one.df) == (50, 48) and one.r == pytest.approx(r) and one.p == pytest.approx(stats.two_sided_p(r, 50), abs=1e-12)
    assert one.ci_low < one.r < one.ci_high and one.t == pytest.approx(r * math.sqrt(48 / (1 - r * r)))
    assert got["all", "c"].r is None and got["all", "c"].p is None
    assert got["few", "a"].n == 3 and got["few", "a"].ci_low is None and got["few", "a"].p is not None
    assert got["two", "a"].p is None and got["two", "a"].t is None and got["none", "a"].n == 0 and got["none", "a"].r is None


def test_histograms_with_round_breaks(spark):
    def bins(values, breaks=None):
        rows = stats.histogram_breaks(spark.createDataFrame([(v,) for v in values], "v double"), "v", breaks).collect()
        return [(round(r.lower, 9), round(r.upper, 9), r.n) for r in sorted(rows, key=lambda r: r.lower)]

    assert bins([0.0, 1.0, 2.0, 9.0, 10.0, None, float("nan")], 5) == [(0, 2, 3), (2, 4, 0), (4, 6, 0), (6, 8, 0), (8, 10, 2)]
    assert bins([0.1 * i for i in range(11)], 10) == [(round(i / 10, 9), round((i + 1) / 10, 9), 2 if i == 0 else 1) for i in range(10)]
    assert bins([5.0, 5.0]) == [(4, 5, 2)] and bins([5.5]) == [(5, 6, 1)] and bins([]) == [] and bins([None]) == []
    many = [random.Random(3).gauss(0, 40) for _ in range(1)] + [random.Random(i).gauss(0, 40) for i in range(99)]
    found = bins(many)
    assert sum(n for *_, n in found) == 100 and 5 <= len(found) <= 13 and found[0][1] > min(many) > found[0][0]


def test_scatter_limits(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 5.1, 2.0), (4, None, 2.0)], "k int, a double, b double")
    assert [r.k for r in stats.scatter_data(df, "a", "b", (1, 5), None, ("k",)).collect()] == [1, 2]


def test_candidates(spark):
    sheet = spark.createDataFrame(
        [(1, 3.0, 46.5, "oui"), (2, 4.0, 46.0, "non"), (3, 2.3498, 48.853, "oui"), (4, 3.0, 46.5, None)], "row int, lon double, lat double, coord_ok string"
    )
    gps = selection.gps_candidates(sheet, "lon", "lat", ["row"])
    got = {r.row: (r.id_plot, round(r.x, 1), round(r.y, 1)) for r in gps.collect()}
    assert got == {1: ("2022_1", 700000.0, 6600000.0), 3: ("2022_2", 652289.6, 6861636.4)} and g.srid_of(gps) == 2154
    plots = spark.createDataFrame(
        [("a", "oui", "ok"), ("b", "oui", None), ("c", "non", "binome_arrachee"), ("d", None, "binome_arrachee"), ("e", "non", "ok")], "id string, exclu string, valide_2022 string"
    )
    assert {r.id for r in selection.exclusion_plots(plots).collect()} == {"a", "c", "d"}


def test_joins_by_shared_names_and_null_keys(spark):
    a = spark.createDataFrame([("1", "u"), (None, "v")], "id_plot string, geometry string")
    b = spark.createDataFrame([("1", 5), (None, 6), ("9", 7)], "id_plot string, share int")
    got = {tuple(r) for r in tables.natural_merge(a, b, "right").select("id_plot", "geometry", "share").collect()}
    assert got == {("1", "u", 5), (None, "v", 6), ("9", None, 7)}
    right = tables.merge(a, b, "id_plot", how="right", null_keys_match=False).select("id_plot", "geometry", "share").collect()
    assert {tuple(r) for r in right} == {("1", "u", 5), (None, None, 6), ("9", None, 7)}


def test_export(spark, tmp_path):
    shape = g.rectangle(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(5.0))
    candidates = spark.createDataFrame([("p2",), ("p1",)], "id_plot string").withColumn("geometry", shape)
    table = spark.createDataFrame([("p1", 1.5), ("p2", 2.5), ("p3", 3.5)], "id_plot string, share double")
    selection.export_candidates(candidates, table, str(tmp_path))
    sheet = layers.read_table(spark, str(tmp_path / "candidates.csv"), "id_plot string, share double", "\t").collect()
    assert sorted(map(tuple, sheet)) == [("p1", 1.5), ("p2", 2.5), ("p3", 3.5)]
    layer, rejects = layers.read_layer(spark, str(tmp_path / "candidates.layer"))
    assert layer.count() == 2 and [r.id_plot for r in rejects.collect()] == ["p3"]


@pytest.mark.parametrize("keys", [list(range(300)), [7] * 40 + [None, 3], []], ids=["many", "ties", "empty"])
def test_sheets_are_written_in_order(spark, tmp_path, keys):
    df = spark.createDataFrame([(k, f"r{i}") for i, k in enumerate(keys)], "k int, v string").repartition(5)
    layers.write_table(df, str(tmp_path / "t"), ";", order=["k"])
    found = []
    for file in sorted(glob.glob(str(tmp_path / "t" / "part-*.csv"))):
        lines = open(file).read().splitlines()
        found += [line.split(";")[0] for line in lines[1:]]
    assert found == ["" if k is None else str(k) for k in sorted(keys, key=lambda k: (k is not None, k))] or found == ['""' if k is None else str(k) for k in sorted(keys, key=lambda k: (k is not None, k))]
    if len(keys) == 300:
        assert len(glob.glob(str(tmp_path / "t" / "part-*.csv"))) > 1


def test_window_reads_few_row_groups(spark, tmp_path):
    cells = spark.range(6400).selectExpr("id AS FID", "(id * 37 % 80) * 100D AS x", "(id * 37 % 6400 div 80) * 100D AS y")
    layer = cells.select("FID", g.rectangle("x", "y", F.col("x") + 90, F.col("y") + 90).alias("geometry"))
    path = str(tmp_path / "layer")
    layers.write_indexed_layer(layer, path, row_group_rows=200)
    window = (1000, 1000, 1500, 1400)
    found, rejects = layers.read_window(spark, path, window)
    want = cells.where("x <= 1500 AND x + 90 >= 1000 AND y <= 1400 AND y + 90 >= 1000")
    assert rejects.isEmpty() and {r.FID for r in found.select("FID").collect()} == {r.FID for r in want.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all(f"({b}" in plan.split("PushedFilters")[1] for b in layers.BOX)
    met = total = 0
    for file in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        for k in range(meta.num_row_groups):
            box = {b: meta.row_group(k).column(at[b]).statistics for b in layers.BOX}
            total += 1
            met += box["xmin"].min <= 1500 and box["xmax"].max >= 1000 and box["ymin"].min <= 1400 and box["ymax"].max >= 1000
    assert total > 20 and met * 4 < total
