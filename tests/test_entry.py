import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
os = pytest.importorskip("os")
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["I08_query_metrics", "K12_quality", "G01_hybrid_search", "N05_mean_children", "M02_new_preferences"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SMALL).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].itertuples(index=False))
    assert key(got) == key(want)
