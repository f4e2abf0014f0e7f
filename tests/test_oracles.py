"""Every registered query of the engine against its SQL on the smallest tables, and the driver's entry points."""

from __future__ import annotations

import duckdb
import pytest

from skeinwork.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, db, tmp_path, name):
    registry.queries()[name](spark, small).write.parquet(str(tmp_path / "got"))
    got = f"SELECT * FROM '{tmp_path}/got/*.parquet'"
    db.execute(f"CREATE OR REPLACE TABLE want AS {SQL[name]}")
    columns = sorted(r[0] for r in db.execute(f"DESCRIBE {got}").fetchall())
    assert columns == sorted(r[0] for r in db.execute("DESCRIBE want").fetchall())
    cols = ", ".join(f'"{c}"' for c in columns)
    n = db.execute("SELECT count(*) FROM want").fetchall()[0][0]
    assert n > 0
    assert n == db.execute(f"SELECT count(*) FROM ({got})").fetchall()[0][0]
    assert db.execute(f"SELECT count(*) FROM (SELECT {cols} FROM ({got}) EXCEPT ALL SELECT {cols} FROM want)").fetchall()[0][0] == 0


def test_review_gate_sql_tells_missing_reviews(db):
    """The SQL of the gate, over reviews that lack a brand, tells that and nothing else, as the query does."""
    whole = SQL["review_gate_reasons"]
    lacking = whole.replace("AS who FROM results)", "AS who FROM results WHERE experiment <> 'Brand#7')")
    assert lacking != whole
    assert db.execute(lacking).fetchall() == db.execute(SQL["review_gate_missing"]).fetchall() == [("Brand#7", "missing")]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
