"""The SQL twins of the training-data queries."""

from pathlib import Path

import duckdb
import pytest

from parallax.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_twin(spark, sf, name):
    tables = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        tables.sql(f"CREATE VIEW {path.stem} AS FROM '{path}'")
    frame, found = queries.queries()[name](spark, sf), tables.sql(queries.SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(found.columns)
    place = [found.columns.index(c) for c in columns]
    assert sorted(map(tuple, frame.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in place) for r in found.fetchall()), key=str)
