"""Some registered queries against their SQL on the smallest tables."""

import glob
import os

import pytest

from chronoweave.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
NAMES = ["k1_interval_union", "k3_uncovered", "k5_primary_gaps", "k9_strict_gaps", "k11_conflicts", "c6_outside_employment", "h36_endpoint", "d11_precision_recall", "i3_feedback_fold", "a28_visible_text"]


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = registry.QUERIES[name](spark, SF)
    db.execute(registry.SQL[name])
    columns = [c[0] for c in db.description]
    assert sorted(columns) == sorted(got.columns)
    assert _plain([tuple(r) for r in got.collect()], got.columns) == _plain(db.fetchall(), columns)


def test_all_queries_have_names_in_order():
    assert len(registry.QUERIES) > 90 and set(registry.SQL) <= set(registry.QUERIES)
