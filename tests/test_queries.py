import glob
import os

import duckdb
import pytest

from bocage.plans import queries as q
from bocage.plans import queries_orchards as o

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = q.queries() | o.queries(), q.oracle_sql() | o.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    want = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]
    assert sorted(names) == columns
    key = lambda row: tuple((v is None, str(v)) for v in row)
    mine = [tuple(r) for r in got.select(*columns).collect()]
    near = lambda a, b: a == b or isinstance(a, float) and a == pytest.approx(float(b), abs=2e-3)
    first = [i for i, c in enumerate(columns) if c in ("FID", "id", "id_plot", "what", "Code_n3", "middle", "FID_plot", "parcelle_suivie", "subset", "lower")]
    first += [i for i, c in enumerate(columns) if c == "x" and "subset" in columns]
    first = list(range(len(columns))) if name == "multi_year" else first  # a plot has a row per year
    at = lambda row: key([row[i] for i in first])
    assert len(mine) == len(want)
    for a, b in zip(sorted(mine, key=at), sorted(want, key=at)):
        assert all(near(x, y) for x, y in zip(a, b)), (a, b)
