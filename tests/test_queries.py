"""Every registered query of the engine against DuckDB on the smallest tables."""

import duckdb
import pytest

from spanweave import oracle, queries

DIR = "/root/testdata/sf0.001"
TABLES = "customer embeddings events lineitem orders pages".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def test_every_query_has_an_oracle():
    assert set(queries.queries()) == set(oracle.SQL)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_oracle(spark, duck, name):
    got, want = queries.queries()[name](spark, DIR).toPandas(), duck.execute(oracle.SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(queries.queries()) <= set(e.queries())
    assert e.entry(spark).columns == ["video", "block", "a", "b", "dance_samples", "n_parts", "dance_span_s", "clip_start_s", "clip_end_s", "clip_dur_s", "kept"]
