"""The recognition stage: pluggable, resumable, with retries and a breaker; batch or stream."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quire.operators.attempts import BLANK_TEXT, DEAD_400, DEAD_PREFIX, wait_seconds

RESULT = "outcome string, attempts int, md string, finish string, tokens_in long, tokens_out long, msg string"
COLUMNS = ["outcome", "attempts", "md", "finish", "tokens_in", "tokens_out", "msg"]
#: Outcomes that later passes need not repeat.
TERMINAL = ("ok", "blank", "dead")
OUTCOMES = ("ok", "blank", "dead", "fail", "unpaid", "skipped")
#: The name under which a stream's results are observed.
OBSERVED = "recognized"
#: Pages between which a pass looks whether credit has run out.
BATCH_PAGES = 2000
Recognizer = Callable[[bytes, str], dict]


def by_content(image: bytes, prompt: str) -> dict:
    """A recogniser without a network or failures: its answer is a function of the image, whatever the bytes are."""
    if not image:
        return {"md": None, "finish": "stop", "tokens_in": 0, "tokens_out": 0, "msg": None}
    name = base64.b32encode(hashlib.sha1(image).digest()).decode()[:8]
    return {"md": f"# {name}\n", "finish": "stop", "tokens_in": len(image), "tokens_out": len(name), "msg": None}


def offline_stub(image: bytes, prompt: str) -> dict:
    """by_content(), but that the three bytes 402, which are no image, stand for a shortage of credit."""
    return {"md": None, "finish": None, "tokens_in": 0, "tokens_out": 0, "msg": "HTTP 402"} if image == b"402" else by_content(image, prompt)


def kind_of_error(msg: str) -> str:
    """refused, unpaid, content, service or other; operators.attempts has the same as expressions."""
    if "HTTP 402" in msg:
        return "unpaid"
    if "HTTP 400" in msg and any(mark in msg for mark in DEAD_400):
        return "refused"
    if "empty content" in msg or "malformed response" in msg:
        return "content"
    return "service" if "HTTP 429" in msg or "HTTP 5" in msg or "timed out" in msg.lower() else "other"


def class_of(msg: str) -> str:
    return re.sub("[0-9]+", "#", msg.split(" | body[:")[0])


def attempted(image: bytes, prompt: str, recognizer: Recognizer, retries: int, pause: Callable[[float], None]) -> dict:
    """One page with its retries, as a row of RESULT.

    An empty answer that ended by itself is a blank page; one that was cut is a content error. Two content errors of one
    class in a row make the page dead, as does a refused image; its placeholder is its text from then on. Errors of the
    service are tried again behind a growing wait; all others, and the last attempt, fail. Every attempt is billed.
    """
    tokens_in = tokens_out = 0
    last = None
    for n in range(1, retries + 2):
        got = recognizer(image, prompt)
        tokens_in, tokens_out = tokens_in + (got["tokens_in"] or 0), tokens_out + (got["tokens_out"] or 0)
        row = {"attempts": n, "md": got["md"], "finish": got["finish"], "tokens_in": tokens_in, "tokens_out": tokens_out, "msg": got["msg"]}
        if not row["msg"] and not (row["md"] or "").strip():
            if row["finish"] == "stop":
                return row | {"outcome": "blank", "md": BLANK_TEXT}
            row["msg"] = f"empty content (finish_reason={row['finish']})"
        if not row["msg"]:
            return row | {"outcome": "ok"}
        kind, this = kind_of_error(row["msg"]), class_of(row["msg"])
        if kind == "refused" or (kind == "content" and this == last):
            return row | {"outcome": "dead", "md": f"{DEAD_PREFIX}: {this.splitlines()[0][:120]} -->"}
        if kind in ("unpaid", "other") or n > retries:
            return row | {"outcome": "unpaid" if kind == "unpaid" else "fail", "md": None}
        last = this if kind == "content" else None
        pause(wait_seconds(n - 1))
    raise AssertionError("the last attempt returns")


def recognize(pages: DataFrame, recognizer: Recognizer = offline_stub, prompt: str = "prompt", retries: int = 4, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """pages (book, stem, content, prompt) -> book, stem, RESULT, a row for each page. A partition stops calling once it
    is out of credit: its other pages are skipped.

    Calls cost money: write the result before using it, and run the stage without speculation.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpaid = False
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                got = {"outcome": "skipped", "attempts": 0, "md": None, "finish": None, "tokens_in": 0, "tokens_out": 0, "msg": "skipped: HTTP 402 before"}
                if not unpaid:
                    got = attempted(r.content, getattr(r, prompt, ""), recognizer, retries, pause)
                    unpaid = got["outcome"] == "unpaid"
                out.append({"book": r.book, "stem": r.stem} | got)
            yield pd.DataFrame(out, columns=["book", "stem", *COLUMNS])

    return pages.mapInPandas(run, f"book string, stem string, {RESULT}")


def terminal(results: DataFrame) -> DataFrame:
    """Results that later passes need not repeat: texts, blank pages and dead ones."""
    return results.where(F.col("outcome").isin(*TERMINAL))


def page_texts(results: DataFrame) -> DataFrame:
    """book, stem, md: one text for each page that has one, placeholders of blank and dead pages included."""
    return terminal(results).groupBy("book", "stem").agg(F.min("md").alias("md"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of all passes so far; none if nothing has been written yet."""
    schema = f"book string, stem string, {RESULT}, pass_id string"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def open_pages(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Pages without a terminal result."""
    return pages.join(terminal(results).select("book", "stem"), ["book", "stem"], "left_anti")


def counted() -> list[Column]:
    """What is observed of results as they are written: how many of each outcome, and tokens."""
    tokens = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")]
    return [*(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES), *tokens]


def write_results(results: DataFrame, path: str, pass_id: str) -> dict:
    """Appends results and tells what was observed while they were written: nothing is read again. Each pass has a folder
    of its own, so that lanes can write at one time, and in it each book."""
    seen = Observation()
    results.observe(seen, *counted()).write.mode("append").partitionBy("book").parquet(f"{path}/pass_id={pass_id}")
    return seen.get


def run_pass(spark: SparkSession, pages: DataFrame, done_path: str, recognizer: Recognizer = offline_stub, batches: int | None = None, tell: Callable[[dict], None] | None = None, pass_id: str | None = None, **options) -> int:
    """Recognises what has no terminal result below done_path, in batches of about BATCH_PAGES; stops between batches
    when this pass has run out of credit (an earlier one's shortage is past). Returns how many pages are still open.
    tell() gets the counts of each batch as it ends."""
    # In order of batches, so that a batch is a stretch of each partition and reads no other.
    todo = open_pages(pages, read_results(spark, done_path)).persist()
    left = todo.count()
    batches = batches or max(1, math.ceil(left / BATCH_PAGES))
    dealt = todo.withColumn("batch_", F.pmod(F.xxhash64("book", "stem"), F.lit(batches))).sortWithinPartitions("batch_").persist()
    try:
        name = pass_id or uuid.uuid4().hex
        for b in range(batches):
            got = write_results(recognize(dealt.where(F.col("batch_") == b).drop("batch_"), recognizer, **options), done_path, name)
            left -= sum(got[o] for o in TERMINAL)
            if tell:
                tell({"pass_id": name, "batch": b, "batches": batches, "open": left, **got})
            if got["unpaid"]:
                break
        return left
    finally:
        dealt.unpersist()
        todo.unpersist()


class Progress(StreamingQueryListener):
    """Writes what is observed of each batch of a stream as an event: one small JSON file for each batch, named by the
    query and the batch, so that a batch that is run again replaces its event."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if OBSERVED in p.observedMetrics and p.numInputRows:
            row = p.observedMetrics[OBSERVED].asDict() | {"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows}
            store, folder = fs.FileSystem.from_uri(self.folder)
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{p.id}-{p.batchId:09d}.json") as out:
                out.write(json.dumps(row).encode())


EVENTS = f"query string, batch long, rows long, {', '.join(f'{o} long' for o in OUTCOMES)}, tokens_in long, tokens_out long"


def stream_new_pages(spark: SparkSession, folder: str, out: str, checkpoint: str, schema: str, recognizer: Recognizer = offline_stub, events: str | None = None, files_per_batch: int | None = None) -> None:
    """Recognises page files that have come since the last run, then ends. The counts of each batch go to `events` as
    it ends: read them with the schema EVENTS."""
    reader = spark.readStream.schema(schema)
    pages = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)
    results = recognize(pages, recognizer)
    listener = Progress(events) if events else None
    if listener:
        results = results.observe(OBSERVED, *counted())
        spark.streams.addListener(listener)
    try:
        query = results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if listener:  # events come on a bus of their own
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        if listener:
            spark.streams.removeListener(listener)


def progress(events: DataFrame) -> DataFrame:
    """The summary of a run from its events (event, seq, payload): the last start and the last done; counts by kind."""
    last = lambda kind: F.max_by("payload", F.when(F.col("event") == kind, F.col("seq")))
    return events.agg(last("start").alias("start"), last("done").alias("done"), *(F.count_if(F.col("event") == k).alias(k) for k in ("page_ok", "page_blank", "page_fail")))
