"""The registry is complete, and a cross-section of the queries gives the rows of its SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canon

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "bm25_topk", "knn_filtered", "hybrid_search", "merge_short", "mode_choice", "strip_repeated_lines", "issue_scan_v2",
    "anchor_align", "clause_lookup", "taxonomy_groups", "multi_gt_rank", "latency_pctl", "history_window", "sla_windows",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_a_check():
    # the training-data subpackage is optional and keeps its own tests
    own = {name for name, fn in entry.queries().items() if fn.__module__.startswith("clauselake.plans")}
    assert own - {"knn_lsh_recall"} <= set(entry.oracle_sql()) and len(own) > 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(canon, r)) for r in df.select(*cols).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == cols
    assert got == sorted(tuple(canon(r[i]) for i in order) for r in cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).columns[:2] == ["query_id", "doc_id"]
