"""Anomalies against a trailing baseline as weeks come and are corrected: keyed state with the last weeks of each entity.

The state (transformWithState, in RocksDB) is a buffer of an entity's weekly rows in order of their weeks, of which the
oldest go once there are more than the baseline, and `late` rows that may still be corrected, need. A row that comes
again for its week replaces the one before. Of what a batch changes, the rows whose baseline or own values changed are judged
again, and their verdicts replace the former ones in a table in parts; so a correction can take an anomaly back. A correction
older than the buffer can't be judged, and is told as too late instead.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.anomalies import BASELINE_ROWS, MIN_MENTIONS, THRESHOLD
from ..operators.facts import upsert
from ..shipping import ship
from .partitioned import PartitionedTable, bucket

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of an entity, from the newest, that may be corrected.
LATE = 26
VERDICTS = "character_id string, week long, year int, sentiment_score double, baseline_mean double, baseline_std double, z_score double, mention_count long, is_anomaly boolean, too_late boolean"
KEY = ["character_id", "week", "year"]
_STATE = "week array<bigint>, year array<int>, score array<double>, mentions array<bigint>, dropped boolean"


def verdicts(rows: list[tuple], first: int, baseline: int, min_mentions: int, threshold: float) -> Iterator[tuple]:
    """(mean, std, z, whether it is an anomaly) of the rows (week, year, score, mentions) from `first` on; nulls where
    the baseline isn't full, or doesn't vary."""
    for i in range(first, len(rows)):
        before = [r[2] for r in rows[max(0, i - baseline) : i]]
        if len(before) < baseline or min(before) == max(before):
            yield None, None, None, False
            continue
        mean = math.fsum(before) / baseline
        std = math.sqrt(math.fsum((x - mean) ** 2 for x in before) / baseline)
        z = (rows[i][2] - mean) / std
        yield mean, std, z, rows[i][3] >= min_mentions and abs(z) > threshold


def merged(rows: list[tuple], new: list[tuple], dropped: bool, baseline: int) -> tuple[list[tuple], int, list[tuple]]:
    """The buffer with new rows in it, the place of the first changed one (its length if none), and those too late.

    The first `baseline` rows of a buffer that has dropped some are only there for the baselines of later ones.
    """
    known, order = {r[:2]: r for r in rows}, [r[:2] for r in rows]
    oldest = order[baseline] if dropped and len(order) > baseline else None
    lost = [r for r in new if oldest is not None and r[:2] < oldest]
    changed = [r for r in new if (oldest is None or r[:2] >= oldest) and known.get(r[:2]) != r]
    known.update({r[:2]: r for r in changed})
    out = [known[k] for k in sorted(known)]
    first = bisect.bisect_left(out, min(changed)[:2], key=lambda r: r[:2]) if changed else len(out)
    return out, first, lost


class TrailingBaseline(StatefulProcessor):
    def __init__(self, baseline: int, min_mentions: int, threshold: float, late: int):
        self.baseline, self.min_mentions, self.threshold, self.late = baseline, min_mentions, threshold, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weeks = handle.getValueState("weeks", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        buffer, dropped = [], False
        if self.weeks.exists():
            week, year, score, mentions, dropped = self.weeks.get()
            buffer = list(zip(map(int, week), map(int, year), map(float, score), map(int, mentions), strict=True))
        new: dict[tuple, tuple] = {}  # of several rows of a batch for a week the last one counts
        for pdf in rows:
            for r in pdf[["week", "year", "score", "mentions"]].itertuples(index=False):
                new[(int(r.week), int(r.year))] = (int(r.week), int(r.year), float(r.score), int(r.mentions))
        buffer, first, lost = merged(buffer, list(new.values()), bool(dropped), self.baseline)
        out = [(key[0], w, y, s, *v[:3], m, v[3], False) for (w, y, s, m), v in zip(buffer[first:], verdicts(buffer, first, self.baseline, self.min_mentions, self.threshold), strict=True)]
        out += [(key[0], w, y, s, None, None, None, m, False, True) for w, y, s, m in lost]
        keep = self.baseline + self.late
        if len(buffer) > keep:
            buffer, dropped = buffer[-keep:], True
        columns = [list(c) for c in zip(*buffer, strict=True)] if buffer else [[], [], [], []]
        self.weeks.update((*columns, dropped))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in VERDICTS.split(", ")])

    def close(self) -> None:
        pass


def judged(weeks: DataFrame, baseline: int = BASELINE_ROWS, min_mentions: int = MIN_MENTIONS, threshold: float = THRESHOLD, late: int = LATE) -> DataFrame:
    """A stream of VERDICTS from one of weekly rows (character_id, week_start, year, mean_sentiment_score, mention_count).

    It is to be started with the state store of PROVIDER, as `follow` does.
    """
    ship(weeks.sparkSession)
    rows = weeks.select("character_id", F.unix_micros(F.col("week_start").cast("timestamp")).alias("week"), "year", F.col("mean_sentiment_score").alias("score"), F.col("mention_count").alias("mentions"))
    return rows.groupBy("character_id").transformWithStateInPandas(TrailingBaseline(baseline, min_mentions, threshold, late), VERDICTS, "Update", "None")


def anomaly_table(spark: SparkSession, path: str, buckets: int = 16) -> PartitionedTable:
    return PartitionedTable(spark, path, VERDICTS, bucket(["character_id"], buckets))


def follow(weeks: DataFrame, table: PartitionedTable, checkpoint: str, **rules) -> None:
    """Brings the table up to date with what is new in the stream."""
    def each(batch: DataFrame, number: int) -> None:
        table.merge(number, batch.where("not too_late"), lambda old, new: upsert(old, new, KEY))

    conf = table.spark.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKSDB)
    try:
        query = judged(weeks, **rules).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
        query.awaitTermination()
    finally:
        conf.set(PROVIDER, before) if before is not None else conf.unset(PROVIDER)


def anomalies(table: PartitionedTable) -> DataFrame:
    """What `operators.anomalies.anomalies` gives of all weeks."""
    week_start = F.timestamp_micros("week").alias("week_start")
    return table.read().where("is_anomaly").select("character_id", week_start, "sentiment_score", "baseline_mean", "baseline_std", "z_score", "mention_count")
