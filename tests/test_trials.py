"""Shuffled looks from the registry of pairs against shuffled stacks."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sarmotion.errors import ArgumentError
from sarmotion.operators import nulls, tracking
from sarmotion.plans import tables
from sarmotion.plans.catalogue import TRACK

SMALL = "/root/testdata/sf0.001"
KEYS = ["film", "trial", "iaz", "irg", "look"]


def rows(frame):
    return {tuple(r[k] for k in KEYS): np.array([r[c] for c in tracking.SERIES] + [r["quality"]], float) for r in frame.collect()}


@pytest.mark.parametrize("reference, chunk, common", [("first", 64, False), ("first", 16, True), ("adjacent", 16, False), ("lag", 64, False)])
def test_pairs_give_the_motion_of_shuffled_stacks(spark, reference, chunk, common):
    stack = tables.film_stack(spark, SMALL)
    params = replace(TRACK, reference=reference, ref_lag=3, looks_per_task=chunk, coherence_min=0.55, remove_common_mode=common)
    found, meta = nulls.trial_motion(stack, params, 3, ["film"])
    want, plain = tracking.track(nulls.shuffled(stack, 3, ["film"]), params, ["film", "trial"])
    assert meta == plain
    got, expected = rows(found), rows(want)
    assert set(got) <= set(expected)
    for key, series in expected.items():
        if key in got:
            assert got[key] == pytest.approx(series, abs=1e-9), key
        else:  # a film without one look of the stack has no row for it
            assert not series[:-1].any()


def test_pixels_are_shuffled_once_whatever_the_trials(spark):
    stack = tables.film_stack(spark, SMALL)
    params = replace(TRACK, reference="first", looks_per_task=64)
    entering = []
    for trials in (2, 9):
        seen = spark.sparkContext.accumulator(0)
        counted = replace(stack, pixels=stack.pixels.where(F.udf(lambda _: (seen.add(1), True)[1], "boolean")("look")))
        nulls.trial_motion(counted, params, trials, ["film"])[0].count()
        entering.append(seen.value)
    assert entering[0] == entering[1] == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()


def test_other_estimators_register_no_pairs(spark):
    stack = tables.film_stack(spark, SMALL)
    with pytest.raises(ArgumentError):
        tracking.track_trials(stack, replace(TRACK, estimator="phase"), nulls.permutations(64, 2), ["film"])
    motion, _ = nulls.trial_motion(stack, replace(TRACK, estimator="phase"), 2, ["film"])
    assert motion.select("trial").distinct().count() == 2
