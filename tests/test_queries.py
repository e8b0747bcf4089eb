"""Registered queries: a selection against DuckDB on the smallest tables (the driver holds all against theirs)."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from quarry.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SELECTED = ["p1_to_relative_posix", "f3_file_exclusion", "f13_discover", "l1_split_lines", "c2_chunk_by_lines", "c4_markdown_sections", "i3_query_terms", "m5_generation_id", "a3_corpus_summary", "r2_secret_findings", "q4_search_bm25", "q5_search_semantic", "t9_conversation_window", "e3_detection_precision_recall"]

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{DATA}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) if isinstance(v, float) else v

    return sorted((tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", SELECTED)
def test_equals_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
