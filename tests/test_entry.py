
import pytest

from conftest import SF001



def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["police_station", "congestion_severity", "n", "avg_score", "closures"]


def test_registry_shape():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100


@pytest.mark.parametrize("key", ["scan_incidents", "analytics_summary", "blueprint", "learning_curve",
                                 "nearest_points", "attribution_label", "vocab_fit", "path_concat"])
def test_oracle_small(spark, key):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[key](spark, SF001)
    cols = sorted(sdf.columns)
    s = sorted(tuple(str(r[c]) for c in cols) for r in sdf.collect())
    cur = con.execute(E.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    d = sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert s == d
