"""Streaming forms agree with their batch twins."""

from __future__ import annotations

import random

import pytest

from orebed.operators import sketches as K
from orebed.streaming import jobs


@pytest.fixture(scope="module")
def ids():
    rng = random.Random(2)
    return [f"u{rng.randrange(70)}" for _ in range(300)]


def test_bloom_state_carries_over(spark, ids):
    df = spark.createDataFrame(list(enumerate(ids)), "seq long, id string")
    source, _ = jobs.replay(df, 3)
    rows = jobs.start_memory(spark, jobs.bloom_state(source, 211), "bloom_out").collect()
    batch = spark.createDataFrame([(s, 0, x) for s, x in enumerate(ids)], "seq long, batch long, id string")
    want = K.bloom_fpr(batch, 211).first()
    assert sum(r.batch_rows for r in rows) == len(ids)
    assert (sum(r.fp for r in rows), sum(r.tn for r in rows)) == (want.fp, want.tn)


def test_reservoir_is_repeatable_and_bounded(spark, ids):
    df = spark.createDataFrame(list(enumerate(ids)), "seq long, id string")
    a, b = (jobs.reservoir_stream(df, 3, slots=20).collect() for _ in range(2))
    assert a == b
    last = max(r.batch for r in a)
    assert len([r for r in a if r.batch == last]) == 20


def test_windowed_counts(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:10:00' AS ts, 'click' AS event_type UNION ALL SELECT timestamp_ntz'2024-01-01 01:10:00', 'click'")
    assert jobs.windowed_counts(df).count() == 2
