"""Queries that take whole tables in all their variety, held against their SQL on larger tables."""

import glob
import os

import pytest

from chronoweave.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.01"


def _plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", ["h18_tokens", "d27_term_vectors", "h53_term_cosine", "k0_find_mentions", "h31_closed_ranges", "h36_endpoint", "b20_request_errors", "h12_emails", "k5_primary_gaps", "k10_date_association", "k16_project_periods", "d6_event_score", "d29_deduplicate_literal", "c11_greedy_matching"])
def test_whole_tables(spark, name):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    db.execute(registry.SQL[name])
    got = registry.QUERIES[name](spark, SF).select([c[0] for c in db.description])
    assert _plain(got.collect()) == _plain(db.fetchall())
