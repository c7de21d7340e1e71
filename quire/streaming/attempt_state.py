"""Attempts as a stream: the state of each page is kept between batches, and a timer tells when it is due again."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from quire.operators.attempts import ATTEMPTS, content_class, ending, wait_seconds

STATE = "attempt int, class string, outcome string, tokens_in long, tokens_out long"
#: outcome is open while attempts go on, due when the wait behind the last one is over, and else the page's end.
TOLD = "attempt int, outcome string, tokens_in long, tokens_out long, due timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Attempts(StatefulProcessor):
    """A page's attempts so far. Its end is sticky: what comes behind it changes nothing. An attempt that is worth a
    retry sets the page's timer to the end of its wait; a later attempt puts that off."""

    def __init__(self, page: list[str], most: int) -> None:
        self.page, self.most = page, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("page", STATE)

    def told(self, key: tuple, attempt: int, outcome: str, tokens_in: int, tokens_out: int, due: pd.Timestamp | None) -> pd.DataFrame:
        return pd.DataFrame({**{c: [v] for c, v in zip(self.page, key)}, "attempt": [attempt], "outcome": [outcome], "tokens_in": [tokens_in], "tokens_out": [tokens_out], "due": pd.Series([due], dtype="datetime64[ns]")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempt, last, outcome, tokens_in, tokens_out = self.state.get() or (0, None, None, 0, 0)
        if outcome:
            return
        due = None
        for r in pd.concat([*rows]).sort_values(["ts", "seq"]).itertuples(index=False):
            attempt, tokens_in, tokens_out = attempt + 1, tokens_in + int(r.tokens_in), tokens_out + int(r.tokens_out)
            this = r.error_class if isinstance(r.error_class, str) else None
            if r.ending != "again":
                outcome = r.ending
            elif this is not None and this == last:
                outcome = "dead"
            elif attempt == self.most:
                outcome = "fail"
            last, due = this, r.ts + pd.Timedelta(seconds=wait_seconds(attempt - 1))
            if outcome:
                break
        for timer in [*self.handle.listTimers()]:
            self.handle.deleteTimer(timer)
        if not outcome:
            self.handle.registerTimer(int(due.timestamp() * 1000))
        self.state.update((attempt, last, outcome, tokens_in, tokens_out))
        yield self.told(key, attempt, outcome or "open", tokens_in, tokens_out, None if outcome else due)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempt, _, outcome, tokens_in, tokens_out = self.state.get()
        if not outcome:
            at = datetime.datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, datetime.timezone.utc).replace(tzinfo=None)
            yield self.told(key, attempt, "due", tokens_in, tokens_out, pd.Timestamp(at))

    def close(self) -> None:
        pass


def watched(attempts: DataFrame, page: list[str], seq: Column, ts: str = "ts", msg: str = "msg", late: str = "1 day", most: int = ATTEMPTS) -> DataFrame:
    """A stream of attempts (page columns, ts, msg, tokens_in, tokens_out) -> page columns and TOLD, a row for each page
    of a batch and one when it is due. Attempts of a page may come in any order within a batch, and later than those of
    other pages by up to `late`; seq orders those of one time. Messages are judged before the state is met, so that
    only short columns go there."""
    m = F.col(msg)
    timed = attempts.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    judged = timed.select(*page, F.col(ts).alias("ts"), seq.alias("seq"), ending(m).alias("ending"), content_class(m).alias("error_class"), F.coalesce("tokens_in", F.lit(0)).alias("tokens_in"), F.coalesce("tokens_out", F.lit(0)).alias("tokens_out"))
    schema = StructType([f for f in attempts.schema.fields if f.name in page])
    for f in StructType.fromDDL(TOLD).fields:
        schema = schema.add(f)
    return judged.groupBy(*page).transformWithStateInPandas(Attempts(page, most), schema, "Append", "EventTime")


def watch(spark: SparkSession, told: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Takes what has come since the last run, writes what is told of it, and ends."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return told.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(told: DataFrame, page: list[str]) -> DataFrame:
    """The last that is known of each page: its end, or open."""
    best = F.max(F.struct("attempt", "outcome", "tokens_in", "tokens_out"))
    return told.where("outcome <> 'due'").groupBy(*page).agg(best.alias("r")).select(*page, "r.*")
