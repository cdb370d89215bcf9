"""The activity timeline kept current over a stream of comments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from threadloom.operators.engagement import BIN


def stream_activity_timeline(comments: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streaming comments -> 30-minute bins per thread.

    In append mode a bin comes out once the watermark has passed its end; rows
    later than ``lateness`` are dropped. State holds one row per open bin.
    """
    timed = comments.filter(F.col("created_utc") > 0).withColumn(
        "created_ts", F.timestamp_seconds("created_utc"))
    return (
        timed.withWatermark("created_ts", lateness)
        .groupBy("thread_id", F.window("created_ts", BIN).alias("_w"))
        .agg(F.count("id").alias("count"), F.avg("score").alias("avg_score"))
        .select("thread_id", F.col("_w.start").alias("bin"), "count", "avg_score")
    )


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    query = (
        stream.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start())
    query.awaitTermination()


#: One row for each closed bin, and one for each row that came after its bin was closed.
TIMELINE = ("thread_id string, bin timestamp, count bigint, avg_score double, late boolean, id string, score bigint, "
            "created_utc double")
BIN_MS = 30 * 60 * 1000


class OpenBins(StatefulProcessor):
    """The open bins of a thread: number of comments, sum and number of scores; each closes by its own timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bins = handle.getMapState("bins", "start bigint", "count bigint, total bigint, scored bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        closed_to = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            start = (pdf["created_utc"] * 1000).astype("int64") // BIN_MS * BIN_MS
            late = start + BIN_MS <= closed_to
            if late.any():
                yield self._frame(key, late=True, **{c: pdf.loc[late, c] for c in ("id", "score", "created_utc")})
            for begin, part in pdf[~late].groupby(start[~late]):
                begin = int(begin)
                known = self.bins.containsKey((begin,))
                count, total, scored = self.bins.getValue((begin,)) if known else (0, 0, 0)
                scores = part["score"].dropna()
                self.bins.updateValue((begin,), (count + int(part["id"].notna().sum()), total + int(scores.sum()), scored + len(scores)))
                if not known:
                    self.handle.registerTimer(begin + BIN_MS)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin = expiredTimerInfo.getExpiryTimeInMs() - BIN_MS
        count, total, scored = self.bins.getValue((begin,))
        self.bins.removeKey((begin,))
        yield self._frame(key, late=False, bin=[pd.Timestamp(begin, unit="ms")], count=[count],
                          avg_score=[total / scored if scored else None])

    def close(self) -> None:
        pass

    @staticmethod
    def _frame(key, late: bool, **columns) -> pd.DataFrame:
        held = {c: list(x) for c, x in columns.items()}
        rows = max(map(len, held.values()))
        held |= {"thread_id": [key[0]] * rows, "late": [late] * rows}
        names = [c.split()[0] for c in TIMELINE.split(", ")]
        # objects: columns of pandas' own string type cannot be parts of a struct
        return pd.DataFrame({c: pd.Series(held.get(c, [None] * rows), dtype="datetime64[ns]" if c == "bin" else object) for c in names})


def timeline_with_late_rows(comments: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streaming comments -> closed bins, and the rows that came too late for theirs.

    Nothing is lost silently: a bin comes out once the watermark has passed its
    end, and a row of a closed bin comes out by itself with ``late`` set. The
    session needs the RocksDB state store.
    """
    timed = comments.filter(F.col("created_utc") > 0).withColumn("created_ts", F.timestamp_seconds("created_utc"))
    # without the time column no row is dropped before the processor sees it; the watermark still moves
    rows = timed.withWatermark("created_ts", lateness).select(
        "thread_id", "id", F.col("score").cast("bigint").alias("score"), F.col("created_utc").cast("double").alias("created_utc"))
    return rows.groupBy("thread_id").transformWithStateInPandas(
        statefulProcessor=OpenBins(), outputStructType=TIMELINE, outputMode="Append", timeMode="EventTime")
