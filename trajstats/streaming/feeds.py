"""Structured Streaming forms of thinning, windowed means and group tracking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trajstats.functions.stats import finite, sem
from trajstats.sources.dumps import stride


def thinned(stream: DataFrame, frame: str, n: int, offset: int = 0) -> DataFrame:
    """Every n-th frame of a feed; stateless."""
    return stride(stream, frame, n, offset)


def windowed_mean(stream: DataFrame, time: str, keys: Sequence[str], value: str, width: str, delay: str) -> DataFrame:
    """Mean, sd, SEM and count per tumbling window, for append mode.

    State holds the running moments per open window and key, not rows. Rows later than
    ``delay`` behind the newest one are dropped. Windows close as time goes on, the last ones by the mark of ``with_end``.
    """
    v = finite(F.col(value).cast("double"))
    out = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("_w"), *keys).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), sem(v).alias("sem"), F.count(v).alias("n")
    )
    return out.select(*keys, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "mean", "sd", "sem", "n").filter(F.col("window_end") < F.lit(END_OF_FEED).cast("timestamp"))


#: Time of the mark that ends a feed, later than any row; pandas counts nanoseconds up to 2262.
END_OF_FEED = "2200-01-01 00:00:00"


def with_end(stream: DataFrame, time: str, marks: str) -> DataFrame:
    """The feed and its marks, files in the folder ``marks``: a mark is a row at ``END_OF_FEED`` without other values, which moves the watermark past all open windows and timers."""
    spark = stream.sparkSession
    ends = spark.readStream.schema("ended boolean").parquet(marks)
    return stream.unionByName(ends.select(F.lit(END_OF_FEED).cast("timestamp").alias(time)), allowMissingColumns=True)


def end_feed(spark: SparkSession, marks: str) -> None:
    """Write the mark; the next run of a query over ``with_end`` closes what is open."""
    spark.range(1).select(F.lit(True).alias("ended")).write.mode("append").parquet(marks)


def make_marks(spark: SparkSession, marks: str) -> None:
    """The folder of marks, still without one."""
    spark.range(0).select(F.lit(True).alias("ended")).write.mode("append").parquet(marks)


class _Follow(StatefulProcessor):
    """Group tracking of one system: the members of the last picked group, and frames that may still be incomplete.

    A timer for each frame fires when the watermark has passed it. Frames are then picked in order, each by the group before it.
    """

    def __init__(self, time: str):
        self.time = time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, members array<long>")
        self.waiting = handle.getMapState("waiting", "ms long", "frame long, chains array<long>, labels array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done = self.last.get()[0] if self.last.exists() else None
        new: dict[int, tuple[int, list, list]] = {}
        for part in rows:
            part = part[part["chain"].notna()]
            for at, group in part.groupby(self.time):
                ms = int(at.timestamp() * 1000)
                if done is None or ms > done:
                    _, chains, labels = new.setdefault(ms, (int(group["frame"].iloc[0]), [], []))
                    chains += group["chain"].astype(int).tolist()
                    labels += group["label"].astype(int).tolist()
        for ms, (frame, chains, labels) in new.items():
            if self.waiting.containsKey((ms,)):
                _, old_chains, old_labels = self.waiting.getValue((ms,))
                chains, labels = list(old_chains) + chains, list(old_labels) + labels
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (frame, chains, labels))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for ms in sorted(k[0] for k in self.waiting.keys() if k[0] <= upto):
            frame, chains, labels = self.waiting.getValue((ms,))
            self.waiting.removeKey((ms,))
            groups: dict[int, set] = {}
            for c, g in zip(chains, labels):
                groups.setdefault(g, set()).add(c)
            before = set(self.last.get()[1]) if self.last.exists() else set()
            label = max(groups, key=lambda g: closeness(before, groups[g], g))
            self.last.update((ms, sorted(groups[label])))
            out.append((frame, label))
        if out:
            yield pd.DataFrame({"system": [key[0]] * len(out), "frame": [f for f, _ in out], "label": [g for _, g in out]})

    def close(self) -> None:
        pass


def closeness(before: set, group: set, label: int) -> tuple:
    """Largest overlap with the last pick, then Jaccard index, closest size, size, lowest member and label."""
    shared = len(before & group)
    union = len(before | group)
    return shared, shared / union if before else 0.0, -abs(len(group) - len(before)) if before else 0, len(group), -min(group), -label


def followed(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """(system, frame, label): one group followed through a feed of (system string, frame long, chain long, label long) rows.

    ``time`` is the event time of a frame, after 1970. Frames are picked in order once the watermark, ``delay`` behind the newest row, has
    passed them; rows of frames that were picked before are late and dropped. State is keyed by system.
    """
    return stream.withWatermark(time, delay).groupBy("system").transformWithStateInPandas(_Follow(time), "system string, frame long, label long", "append", "EventTime")
