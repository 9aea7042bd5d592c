"""Every registered query against its SQL on the smallest tables."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from postmill.plans import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
LANDING = {"incremental_rounds", "round_metrics", "outbox_rounds", "retry_undelivered", "rejected_listings", "stream_dedupe_seeded"}  # run a stream while they are built


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain(df.collect(), df.columns) == plain(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in LANDING])
def test_plan_has_no_unbounded_step(spark, sf_dir, plan, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert not re.search("NestedLoop|Cartesian", text)
    # Python UDFs evaluated row by row would show as BatchEvalPython.
    assert "BatchEvalPython" not in text
    # Whole frames in one partition: only one row per task may come there.
    for line in text.split("\n"):
        assert "CollectLimit" not in line


def test_entry(spark):
    assert entry.entry(spark).count() > 0
