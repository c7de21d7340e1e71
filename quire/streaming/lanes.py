"""Books in lanes: each lane takes the next book of a queue and runs its jobs; when credit is out all lanes stop."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.batch import PASSES
from quire.streaming.recognize import Recognizer, offline_stub, run_pass

STARTED = "slug string, lane int, outcome string, passes int, secs double, error string"
#: book, number of the pass -> (whether it has its output, whether credit is out)
Work = Callable[[str, int], tuple[bool, bool]]
#: Seconds between looks at the lanes while they stop.
LOOK = 0.2


def run_lanes(spark: SparkSession, queue: DataFrame, work: Work, lanes: int = 4, order: str = "slug", passes: int = PASSES) -> DataFrame:
    """slug, lane, outcome, passes, secs, error for every book of the queue (slug and order).

    A lane is a thread that takes the next book and runs work(slug, pass) up to `passes` times; its Spark jobs run in a
    pool of its own (fair ones if spark.scheduler.mode is FAIR) under one tag. outcome is output, given_up behind the
    last pass, failed (an error of the book's own, which the lane survives), or unpaid: then no other book is started
    and the jobs of the other lanes are cancelled by their tag; their books are `stopped`. Books that no lane took are
    not_started. The queue streams past the driver; it keeps a short row for each book that was started.
    """
    sc, tag, stop, lock = spark.sparkContext, f"quire-lanes-{uuid.uuid4().hex}", threading.Event(), threading.Lock()
    waiting = iter(queue.select("slug", order).distinct().orderBy(order, "slug").select("slug").toLocalIterator())
    started: list[tuple] = []

    def next_book() -> str | None:
        with lock:
            found = None if stop.is_set() else next(waiting, None)
        return found.slug if found is not None else None

    def one_book(slug: str) -> tuple[str, int]:
        for n in range(1, passes + 1):
            has_output, unpaid = work(slug, n)
            if has_output or unpaid:
                if not has_output:
                    stop.set()
                return "output" if has_output else "unpaid", n
            if stop.is_set():
                return "stopped", n
        return "given_up", passes

    def lane(n: int) -> None:
        sc.setLocalProperty("spark.scheduler.pool", f"lane-{n}")
        sc.setInterruptOnCancel(True)
        while (slug := next_book()) is not None:
            sc.addJobTag(tag)  # not while the queue is read
            began, error = time.monotonic(), None
            try:
                outcome, at = one_book(slug)
            except Exception as e:
                outcome, at, error = ("stopped", 0, None) if stop.is_set() else ("failed", 0, str(e)[:1000])
            sc.removeJobTag(tag)
            with lock:
                started.append((slug, n, outcome, at, time.monotonic() - began, error))

    threads = [InheritableThread(target=lane, args=(n,), session=spark) for n in range(lanes)]
    for t in threads:
        t.start()
    while any(t.is_alive() for t in threads):
        for t in threads:
            t.join(LOOK)
        if stop.is_set():  # again and again: a lane may have been between two jobs
            sc.cancelJobsWithTag(tag)
    told = spark.createDataFrame(started, STARTED)
    idle = queue.select("slug").distinct().join(told.select("slug"), "slug", "left_anti")
    none = {"lane": "int", "passes": "int", "secs": "double", "error": "string"}
    empty = idle.select("slug", F.lit("not_started").alias("outcome"), *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    return told.unionByName(empty)


def recognizing(spark: SparkSession, pages: DataFrame, done_path: str, recognizer: Recognizer = offline_stub, **options) -> Work:
    """Work of a lane: a pass over the open pages of one book, whose output is there when none is open. Of results only
    the book's folders are read, and each pass writes to one of its own."""

    def work(slug: str, n: int) -> tuple[bool, bool]:
        unpaid = []
        left = run_pass(spark, pages.where(F.col("book") == slug), done_path, recognizer, tell=lambda got: unpaid.append(got["unpaid"] > 0), **options)
        return left == 0, any(unpaid)

    return work
