"""Every registered query of the core against its SQL in DuckDB."""

import duckdb
import pytest

from typeloom.plans.queries import O, Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.mark.parametrize("name", sorted(O))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(O[name])
    columns = sorted(rel.columns)
    want = sorted(tuple(map(str, r)) for r in con.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({O[name]})").fetchall())
    frame = Q[name](spark, SF)
    assert sorted(frame.columns) == columns
    got = sorted(tuple("true" if x is True else "false" if x is False else str(x) for x in r) for r in frame.select(*columns).collect())
    assert [tuple(x.lower() if x in ("True", "False") else x for x in r) for r in want] == got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5


def test_large_hierarchies(spark, monkeypatch):
    """as a large table's, the hierarchies' headers equal the SQL too."""
    from typeloom.operators import slices
    from typeloom.plans import queries

    monkeypatch.setattr(queries, "SMALL", 0)
    monkeypatch.setattr(slices, "LARGEST_SHARE", 1.0)
    test_query(spark, "hierarchy_header_text")
