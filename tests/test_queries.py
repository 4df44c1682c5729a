"""Every named query of the catalogue against its SQL, on the small tables."""

import os

import duckdb
import pytest

from lintel.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    return round(v, 9) if isinstance(v, float) else v


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if not n.startswith("rule_")] + ["rule_missing_main_landmark", "rule_presentational_spacing", "rule_heading_order_skip"])
def test_query(spark, sf_dir, con, name):
    got = catalog.QUERIES[name](spark, sf_dir)
    cur = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(columns)
    want = sorted((tuple(plain(v) for v in row) for row in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in row) for row in got.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want
