"""Every registered query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from parallax.plans import oracle, program_queries, queries, table_queries

SQL = oracle.SQL | program_queries.SQL | table_queries.SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    frame = queries.QUERIES[name](spark, SF)
    found = tables.sql(SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(found.columns)
    place = [found.columns.index(c) for c in columns]
    rows = sorted((tuple(map(plain, r)) for r in frame.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in place) for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["resample_numpy", "cluster_bootstrap"])
def test_published_draws(spark, name):
    from parallax.operators import infer

    rows = queries.QUERIES[name](spark, SF).collect()
    assert rows and {r.n_resamples for r in rows} == {infer.SIGN_FLIPS}


#: Answers at sf0.1, where the SQL has none: a direct run of the generator and of the tests over the SQL engine's deltas.
AT_600_000 = {
    "cluster_bootstrap": [
        ("C1", 25, 192313, 200000, 0.961565, -245.280598, 39.550875, 0.96226, 0.961267),
        ("C2", 25, 7126, 200000, 0.035635, -49.337944, 340.693589, 0.03774, 0.035095),
        ("C3", 25, 65935, 200000, 0.329678, -184.671266, 276.040931, 0.345759, 0.330504),
        ("C4", 25, 134065, 200000, 0.670327, -276.040931, 184.671266, 0.663962, 0.669496),
    ],
    "resample_numpy": [
        ("C1", 1000, 180708, 200000, 0.90354, -355.899402, 113.057762, 0.922649, 0.904521),
        ("C2", 1000, 14103, 200000, 0.07052, -99.229633, 366.718575, 0.098789, 0.070596),
        ("C3", 1000, 87562, 200000, 0.437813, -219.641837, 247.446124, 0.518553, 0.439084),
        ("C4", 1000, 175576, 200000, 0.877881, -247.446124, 219.641837, 0.481447, 0.560916),
    ],
}


@pytest.mark.parametrize("name", sorted(AT_600_000))
def test_resampling_beyond_the_recorded_scales(spark, name):
    rows = queries.QUERIES[name](spark, "/root/testdata/sf0.1").collect()
    assert sorted(tuple(map(plain, r)) for r in rows) == [tuple(map(plain, r)) for r in AT_600_000[name]]
