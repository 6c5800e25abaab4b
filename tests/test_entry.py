"""Every named query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from episodia.checks.oracles import ORACLES
from episodia.checks.registry import QUERIES
from episodia.checks.views import SCHEMAS


@pytest.fixture(scope="module")
def oracle(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tiny}/{name}.parquet'")
    return con


def comparable(rows):
    def value(v):
        return round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(map(value, row)) for row in rows), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, tiny, oracle, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    expected = oracle.execute(ORACLES[name])
    found = [d[0] for d in expected.description]
    assert sorted(found) == columns
    order = [found.index(c) for c in columns]
    rows = comparable([tuple(row[i] for i in order) for row in expected.fetchall()])
    assert comparable(df.select(*columns).collect()) == rows


def test_transcript_files_of_episodes_over_999(spark, tmp_path):
    rows = [(conv, turn, "user", f"said {conv} {turn}") for conv in (100, 1000, 1001, 10007, 123456) for turn in range(2)]
    spark.createDataFrame(rows, SCHEMAS["conversations"]).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = QUERIES["transcript_files"](spark, str(tmp_path)).select("campaign", "episode", "chars", "text_md5").collect()
    assert comparable(found) == comparable(con.execute(ORACLES["transcript_files"]).fetchall())


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) == set(ORACLES)
    assert entry_module.entry(spark).count() > 0


def test_stream_query_equals_batch_query(spark, tiny):
    pick = ["id", "context_window_id", "attempted_parse", "parse_confidence", "score", "answer"]
    streamed = QUERIES["score_stream"](spark, tiny).select(*pick).collect()
    batch = QUERIES["score_boxed"](spark, tiny).select(*pick).collect()
    assert comparable(streamed) == comparable(batch)
