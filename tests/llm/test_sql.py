"""The corpus queries that have an SQL twin against DuckDB, value by value."""

import duckdb
import pytest

from terradelta.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_hashes_in_sql():
    import random

    import xxhash

    from terradelta.llm.sql import xxh64_steps

    r = random.Random(1)
    texts = {"".join(r.choice("abc dé") for _ in range(k)) for k in range(1, 120)}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE names (shingle VARCHAR)")
    duck.executemany("INSERT INTO names VALUES (?)", [[x] for x in texts])
    found = dict(duck.sql("WITH " + xxh64_steps("names", "shingle").strip() + " SELECT shingle, h FROM hashed").fetchall())
    assert found == {x: xxhash.xxh64_intdigest(x.encode(), 42) for x in texts}
