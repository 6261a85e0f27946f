import __spark_entry__
import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or isinstance(x, float) and x != x:
        return ""
    return repr(x) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", [k for k in __spark_entry__.oracle_sql() if not k.startswith("op")])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(__spark_entry__.oracle_sql()[name]).df(), __spark_entry__.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = lambda f: sorted(tuple(map(plain, r)) for r in f[columns].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["cluster_id", "uuid", "rank", "winner", "ambiguous"]
