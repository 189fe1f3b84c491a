"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import os

import pytest

from tessera.plans import queries as plans

from .oracle import compare, connect

SF = os.environ.get("PLANS_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql(spark, con, name):
    compare(spark, con, name, plans.queries()[name], plans.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_sentences_hold_every_event(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id", "user_id", "event_type").collect()
    want = {}
    for e in sorted(events, key=lambda e: (e.ts, e.event_id)):
        want.setdefault((e.user_id, e.ts.date()), []).append(e.event_type)
    got = plans._sentences(plans.Tables(spark, SF)).collect()
    assert {(r.user_id, r.day): r.text.split() for r in got} == want and len(got) == len(want)
    parsed = plans.queries()["cyk_parse"](spark, SF).collect()
    assert sorted((r.user_id, r.day) for r in parsed) == sorted(want)
    assert sum(r.tree is not None for r in parsed) > 0
