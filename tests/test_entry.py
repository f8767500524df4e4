"""Driver contract: entry runs, every query has a callable, oracle keys match queries."""

import duckdb

import __spark_entry__ as E
from folio.sources.testcorpus import TABLES
from tests.conftest import SF


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 20 and set(df.columns) >= {"doc_id", "score", "snippet"}


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150


def test_sample_against_oracle(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q, o = E.queries(), E.oracle_sql()
    for name in ("t6_bm25_top20", "j5_duplicates", "g4_tag_cloud_lineitem", "w1_metric_history", "q3_prefix_completion"):
        got = q[name](spark, SF)
        a = sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.select(*sorted(got.columns)).collect())
        cur = con.execute(f"SELECT * FROM ({o[name]}) ORDER BY ALL")
        cols = [d[0] for d in cur.description]
        idx = sorted(range(len(cols)), key=lambda i: cols[i])
        b = sorted(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in idx) for r in cur.fetchall())
        assert a == b, name
