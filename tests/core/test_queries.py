"""Every query with SQL equals it on the smallest tables; the others run."""

import duckdb
import pytest

from tidemark import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, small, same):
    assert same(registry.queries()[name](spark, small), SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_runs(name, spark, small):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 10
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.fixture(scope="session")
def odd_vectors(tmp_path_factory):
    """A folder with embeddings in copies, of length 0 and null, and its connection."""
    d, c = tmp_path_factory.mktemp("odd"), duckdb.connect()
    kind = lambda i: "NULL" if i % 50 == 7 and i % 3 == 0 or i % 17 == 4 else "[0, 0, 0]" if i % 19 == 2 else f"[{i % 5 - 2}, {i % 7 - 3}, 1]"
    c.sql("CREATE TABLE embeddings AS SELECT i::BIGINT AS vec_id, v::FLOAT[] AS embedding, l::INT AS label FROM (VALUES " + ", ".join(f"({i}, {kind(i)}, {i // 3 % 4})" for i in range(400)) + ") t(i, v, l)")
    c.sql(f"COPY embeddings TO '{d}/embeddings.parquet'")
    return str(d), c


def _same_on(odd, spark, name):
    d, c = odd
    got = registry.queries()[name](spark, d)
    text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    cols = ", ".join(f'"{x}"' for x in got.columns)
    return text(got.collect()) == text(c.sql(f"SELECT {cols} FROM ({SQL[name]})").fetchall())


def test_gold_rank_of_odd_vectors(spark, odd_vectors):
    assert _same_on(odd_vectors, spark, "jn16_gold_rank")


def test_baseline_of_odd_vectors(spark, odd_vectors):
    assert _same_on(odd_vectors, spark, "jn14_baseline")
