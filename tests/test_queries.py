"""Every registered query of the call graph against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from skeingraph import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


#: The seeds' filters in the SQL of the queries on a part of the seeds, and what stands there for all of them.
SEEDS = {
    "descendant_calls": [("id % 40 = 3", "true"), ("caller_symbol_id % 40 = 3", "caller_symbol_id IN (SELECT id FROM t0)"), ("s.id % 40 <> 3", "false")],
    "interface_expansion": [("WHERE p_partkey BETWEEN 2 AND 9", "WHERE p_partkey IN (SELECT interface_method_id FROM b0)")],
    "inherited_min_depth": [(" AND id % 8 = 0", "")],
}


@pytest.mark.parametrize("name", sorted(SEEDS))
def test_all_seeds(spark, duck, name):
    sql = queries.SQL[name]
    views = queries.Views(spark, DIR)
    duck.register("t0", views.symbols.select("id").toArrow())
    duck.register("b0", views.interface_method_bindings.select("interface_method_id").toArrow())
    for a, b in sorted(SEEDS[name], key=lambda x: -len(x[0])):
        assert a in sql
        sql = sql.replace(a, b)
    got = queries.QUERIES[name + "_all"](spark, DIR)
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == rows(columns, want.fetchall()) and len(found) > queries.QUERIES[name](spark, DIR).count()


def test_flagship(spark):
    assert [r["symbols"] for r in queries.flagship(spark, DIR).collect()][0] > 0
