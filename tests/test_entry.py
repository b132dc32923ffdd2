from pathlib import Path

import pytest

import __spark_entry__ as entry
import oracle

DATA = Path("/root/testdata/sf0.001")


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and all(f.__doc__ for f in q.values())
    assert {f"p{n}_found" for n in (2, 3, 5)} <= set(q)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_queries_equal_their_sql(spark):
    names = ["bead_qc_table", "nucleus_marker_features", "cliffs_delta_vs_control", "interval_overlap", "p3_found", "p5_found", "stream_ingest_counts"]
    assert oracle.main(["--sf", str(DATA), *names]) == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
