"""Every query against its SQL at the smallest scale, and what the plans promise."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

from sarmotion.plans import tables  # noqa: E402
from sarmotion.plans.catalogue import QUERIES  # noqa: E402
from sarmotion.plans.oracle import ORACLE  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, db, name):
    same, note = compare.compare(spark, db, SMALL, name)
    assert same, note


def test_every_query_has_its_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLE)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_use(spark):
    text = plan(entry.queries()["window_spectrum"](spark, SMALL))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,value:double>" in text
    assert "event_type" not in text and "props" not in text


def test_series_need_two_shuffles(spark):
    """One to fold events into slots, one to gather a window's slots."""
    text = plan(tables.event_series(spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 2


def test_change_map_shuffles_its_pixels_once(spark):
    text = plan(entry.queries()["change_map"](spark, SMALL))
    by_place = [x for x in text.splitlines() if "Exchange hashpartitioning(_ta" in x]
    assert len(by_place) == 1
    # Every window function runs inside that placement.
    assert text.count("Window [") >= 4


def test_backprojection_shuffles_images_not_pulses(spark):
    text = plan(entry.queries()["backproject"](spark, SMALL))
    below = text[text.index("MapInArrow") :]
    assert "Exchange" not in below
