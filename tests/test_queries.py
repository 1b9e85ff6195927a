import duckdb
import pytest

from quarrymill.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = ("lineitem", "part", "orders", "supplier", "customer", "events")


def plain(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, name):
    df = plans.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert plain(df.select(*cols).collect()) == plain([r[i] for i in at] for r in want.fetchall())
