"""Log clocks and tails in a stream: state keyed by session.

A session's lines are numbered. The state of a session is the number of the last line
sent, the clock (last second of day, days passed) and the lines that came too
early. A line is sent when all before it are, so any split of the log into
micro-batches, in any order, sends what the batch operator ``logs.clock`` gives; a line
that was sent already (the backlog's lines come again with the live ones) is left
out, also after a restart, as the state is in the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import parse

LINE = "session string, seq long, text string"
SENT = "session string, seq long, msg string, ts long, last boolean"
STATE = "position long, second int, days long, waiting string, ended boolean"
TERMINAL = r"^Scan (complete|stopped)\."
DAY = 86400


class Clock:
    """The clock and queue of one session. A plain object, as state is kept by value."""

    def __init__(self, first: int, saved: tuple | None = None):
        self.position, self.second, self.days, waiting, self.ended = saved or (first - 1, None, 0, "[]", False)
        self.waiting = {row[0]: row for row in json.loads(waiting)}

    def saved(self) -> tuple:
        return self.position, self.second, self.days, json.dumps(sorted(self.waiting.values())), self.ended

    def put(self, seq: int, second: int | None, msg: str, last: bool) -> None:
        if seq > self.position:
            self.waiting.setdefault(seq, [seq, second, msg, last])

    def take(self, flush: bool = False) -> Iterator[tuple]:
        """Lines that are next; with ``flush`` all that wait, over gaps."""
        while self.waiting:
            seq = min(self.waiting) if flush else self.position + 1
            if seq not in self.waiting:
                return
            _, second, msg, last = self.waiting.pop(seq)
            if second is not None:
                self.days += self.second is not None and second < self.second
                self.second = second
            self.position, self.ended = seq, self.ended or last
            yield seq, msg, (self.second or 0) + self.days * DAY, last


def clocked(lines: DataFrame, first: int = 1, patience: str | None = None, terminal: str = TERMINAL) -> DataFrame:
    """session, seq, msg, ts, last for each line of a stream (session, seq, text), once and in order.

    ``seq`` counts from ``first`` without gaps. ``patience`` (milliseconds as text) is how
    long lines wait for one that is missing; without it they wait for ever. ``last``
    marks lines that end a scan. A session is one key and so one task a batch.
    """
    wait = int(patience) if patience else 0

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = Clock(first, state.get if state.exists else None)
        for p in parts:
            for seq, second, msg, last in zip(p["seq"], p["second_of_day"], p["msg"], p["last"], strict=True):
                clock.put(int(seq), None if pd.isna(second) else int(second), msg, bool(last))
        sent = list(clock.take(flush=state.hasTimedOut))
        state.update(clock.saved())
        if wait and clock.waiting:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame([(key[0], *row) for row in sent], columns=["session", "seq", "msg", "ts", "last"])

    rows = parse(lines, "text").select("session", "seq", "second_of_day", F.coalesce("msg", F.lit("")).alias("msg"), F.coalesce(F.col("msg").rlike(terminal), F.lit(False)).alias("last"))
    mode = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    return rows.filter(F.col("seq").isNotNull()).groupBy("session").applyInPandasWithState(step, SENT, STATE, "append", mode)


def backlog_then_live(spark: SparkSession, backlog: str, live: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the lines that are there and of those that come, as Parquet files of
    ``LINE``; lines that both folders hold come twice, ``clocked`` sends them once."""
    live_rows = spark.readStream.schema(LINE).option("maxFilesPerTrigger", files_a_batch).parquet(live)
    return spark.readStream.schema(LINE).parquet(backlog).unionByName(live_rows)


def send(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table, each line exactly once; then stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
