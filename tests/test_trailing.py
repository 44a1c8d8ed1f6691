"""Anomalies from keyed state against those of all weeks, after every batch."""

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import anomalies as A
from tidemark.streaming import trailing

WEEK = "character_id string, year int, week_start timestamp, mean_sentiment_score double, mention_count long"


def plain(df):
    return sorted((r.character_id, str(r.week_start), round(r.sentiment_score, 6), round(r.baseline_mean, 6), round(r.baseline_std, 6), round(r.z_score, 6), r.mention_count) for r in df.collect())


@pytest.mark.parametrize("seed", [1])
def test_equals_all_weeks_after_every_batch(spark, tmp_path, seed):
    rng, start = random.Random(seed), datetime(2023, 1, 2)
    row = lambda c, w: (c, (start + timedelta(7 * w)).year, start + timedelta(7 * w), rng.choice([0.0, 0.1, 0.2, 0.9, -0.9]), rng.choice([5, 10, 40]))
    table, known = trailing.anomaly_table(spark, str(tmp_path / "anomalies"), 4), {}
    found = 0
    for batch in range(3):
        new = [row(c, w) for c in "abc" for w in range(14 * batch, 14 * batch + 14) if rng.random() < 0.95]
        # late rows and corrections, not older than the buffer
        new += [row(c, w) for c in "ab" for w in rng.sample(range(max(0, 14 * batch - 12), 14 * batch + 1), min(3, 14 * batch))] if batch else []
        new = list({r[:3]: r for r in new}.values())
        known |= {r[:3]: r for r in new}
        spark.createDataFrame(new, WEEK).coalesce(1).write.mode("append").parquet(str(tmp_path / "weeks"))
        trailing.follow(spark.readStream.schema(WEEK).parquet(str(tmp_path / "weeks")), table, str(tmp_path / "cp"), threshold=1.5)
        want = plain(A.anomalies(spark.createDataFrame(list(known.values()), WEEK), threshold=1.5))
        assert plain(trailing.anomalies(table)) == want
        found += len(want)
    assert found > 5


def test_buffer_and_late_rows():
    weeks = [(w, 2020, float(w % 3), 20) for w in range(10)]
    out, first, lost = trailing.merged(weeks, [(3, 2020, 9.0, 20), (12, 2020, 1.0, 20)], False, 4)
    assert [r[0] for r in out] == [*range(10), 12] and first == 3 and not lost
    # once rows have been dropped, the first ones only carry baselines
    out, first, lost = trailing.merged(weeks, [(3, 2020, 9.0, 20), (4, 2020, 9.0, 20)], True, 4)
    assert first == 4 and lost == [(3, 2020, 9.0, 20)] and out[3][2] == 0.0
    assert trailing.merged(weeks, [weeks[5]], False, 4)[1] == 10  # the same again changes nothing
    constant = [(w, 2020, 0.1, 20) for w in range(5)]
    assert list(trailing.verdicts(constant, 4, 4, 10, 2.0)) == [(None, None, None, False)]
