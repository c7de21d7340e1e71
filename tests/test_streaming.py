"""Streams with state, lanes, and what is told while they run."""

import datetime
import os
import time
import uuid

from pyspark.sql import functions as F

from quire.operators import attempts, cost
from quire.streaming import attempt_state, lanes, recognize, requests, smoke

EMPTY, ODD = "empty content (finish_reason=length)", "malformed response line 1"
ATTEMPT = "page string, ts timestamp, n long, msg string, tokens_in long, tokens_out long"


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, late="10 seconds"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ATTEMPT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ATTEMPT).parquet(str(tmp_path / "in"))
        told = attempt_state.watched(stream, ["page"], F.col("n"), late=late)
        attempt_state.watch(spark, told, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    return spark.read.schema(f"page string, {attempt_state.TOLD}").parquet(str(tmp_path / "out"))


def test_state_outlives_a_restart(spark, tmp_path):
    """Every page's attempts are dealt to two runs; ends stay, whatever comes behind them."""
    pages = {"dead": [EMPTY, EMPTY, None], "ok": ["HTTP 503", ODD, EMPTY, None, "HTTP 403"], "fail": ["HTTP 429"] * 6, "other": ["HTTP 403", None], "blank": ["timed out", attempts.BLANK_MARK], "between": [EMPTY, "HTTP 503", EMPTY, "HTTP 500"], "refused": [None, "HTTP 400 data_inspection_failed"]}
    rows = [(p, at(i), i, m, 10, None if i % 2 else 1) for p, ms in pages.items() for i, m in enumerate(ms)]
    told = run(spark, tmp_path, [[r for r in rows if r[2] < 2][::-1], [r for r in rows if r[2] >= 2]], late="1 hour")
    batch = attempts.outcomes(spark.createDataFrame(rows, ATTEMPT).fillna(0, ["tokens_out"]), ["page"], ["n"])
    key = lambda r: (r.page, r.attempt, r.outcome, r.tokens_in, r.tokens_out)
    assert sorted(map(key, attempt_state.latest(told, ["page"]).collect())) == sorted(map(key, batch.collect()))
    assert {r.page: r.outcome for r in told.where("outcome not in ('open', 'due')").collect()} == {"dead": "dead", "ok": "ok", "fail": "fail", "other": "fail", "blank": "blank", "refused": "ok"}


def test_a_page_is_due_when_its_wait_is_over(spark, tmp_path):
    """The second attempt's wait is 2.5 seconds; an attempt before that puts the timer off, an end takes it away."""
    first = [("a", at(0), 0, "HTTP 503", 1, 1), ("a", at(1), 1, "HTTP 503", 1, 1), ("b", at(0), 0, "HTTP 503", 1, 1), ("c", at(0), 0, "HTTP 503", 1, 1), ("c", at(0.5), 1, None, 1, 1)]
    told = run(spark, tmp_path, [first, [("z", at(100), 0, None, 1, 1)]])
    due = sorted((r.page, r.attempt, r.due) for r in told.where("outcome = 'due'").collect())
    assert due == [("a", 2, at(3.5)), ("b", 1, at(1))]
    assert {r.page: r.outcome for r in attempt_state.latest(told, ["page"]).collect()} == {"a": "open", "b": "open", "c": "ok", "z": "ok"}


def page_rows(spark, counts, start=b"page"):
    rows = [(b, f"p{i}", bytearray(start + f" {b} {i}".encode()), "") for b, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "book string, stem string, content binary, prompt string")


def test_lanes_do_all_books(spark, tmp_path):
    pages = page_rows(spark, {f"b{i}": 3 for i in range(7)})

    def answer(image, prompt):
        if image.startswith(b"page b3"):
            raise ValueError("lost")
        return recognize.offline_stub(image, prompt) if not image.startswith(b"page b5 1") else {"md": None, "finish": None, "tokens_in": 1, "tokens_out": 0, "msg": "HTTP 403"}

    told = lanes.run_lanes(spark, pages.select(F.col("book").alias("slug")), lanes.recognizing(spark, pages, str(tmp_path / "done"), answer, batches=1), lanes=3).collect()
    assert {r.slug: (r.outcome, r.passes) for r in told} == {f"b{i}": {3: ("failed", 0), 5: ("given_up", 2)}.get(i, ("output", 1)) for i in range(7)}
    assert {r.lane for r in told} <= {0, 1, 2} and ["lost" in (r.error or "") for r in told if r.slug == "b3"] == [True]
    done = recognize.read_results(spark, str(tmp_path / "done"))
    assert recognize.terminal(done).groupBy("book").count().where("count > 3").isEmpty() and done.where("book = 'b5' and outcome = 'fail'").count() == 2


def test_a_shortage_of_credit_stops_running_lanes(spark, tmp_path):
    """One lane runs out of credit while the others are in the middle of long jobs: these are cancelled, and no other
    book is started."""
    began, pages = time.monotonic(), page_rows(spark, {"a": 1, "b": 400, "c": 400, "d": 2, "e": 2})
    running = {n: str(tmp_path / n) for n in "bc"}

    def answer(image, prompt):
        book = image.decode().split()[1]
        if book == "a":
            while not all(os.path.exists(p) for p in running.values()):
                time.sleep(0.1)
            return {"md": None, "finish": None, "tokens_in": 0, "tokens_out": 0, "msg": "HTTP 402 no credit"}
        open(running[book], "a").close()
        time.sleep(0.5)
        return recognize.offline_stub(image, prompt)

    told = lanes.run_lanes(spark, pages.select(F.col("book").alias("slug")), lanes.recognizing(spark, pages.repartition(2), str(tmp_path / "done"), answer, batches=1), lanes=3).collect()
    assert {r.slug: r.outcome for r in told} == {"a": "unpaid", "b": "stopped", "c": "stopped", "d": "not_started", "e": "not_started"}
    assert time.monotonic() - began < 90  # 200 seconds if the jobs went on
    assert recognize.terminal(recognize.read_results(spark, str(tmp_path / "done"))).isEmpty()  # cancelled jobs commit nothing


def asking(folder, answers=lambda images: None):
    """A model whose calls leave a file each."""

    def model(images, prompt):
        os.makedirs(folder, exist_ok=True)
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        md = answers(images) or f'{{"title": "{len(images)} {images[0].decode()}", "cover_page": 2}}'
        return {"md": md, "tokens_in": 1_000_000, "tokens_out": 0, "msg": None}

    return model


def calls(folder):
    return len(os.listdir(folder)) if os.path.isdir(folder) else 0


def test_contexts_are_asked_for_once(spark, tmp_path):
    pages, folder, cache = page_rows(spark, {"a": 20, "b": 3}), str(tmp_path / "calls"), str(tmp_path / "cache")
    twin = page_rows(spark, {"b": 3}).withColumn("book", F.lit("twin"))  # the same images: one request
    got = {r.book: r for r in requests.prepass(spark, pages.union(twin), cache, asking(folder), "p").collect()}
    assert {b: (r.context.title, r.from_cache, r.tokens_in) for b, r in got.items()} == {"a": ("15 page a 0", False, 1_000_000), "b": ("3 page b 0", False, 1_000_000), "twin": ("3 page b 0", False, 1_000_000)}
    assert calls(folder) == 2 and str(got["a"].cost_usd) == "0.320000" and "15 page a 0" in got["a"].block
    again = {r.book: (r.context.title, r.from_cache, r.tokens_in) for r in requests.prepass(spark, pages, cache, asking(folder), "p").collect()}
    assert calls(folder) == 2 and again == {"a": ("15 page a 0", True, 0), "b": ("3 page b 0", True, 0)}
    more = requests.prepass(spark, page_rows(spark, {"b": 4}), cache, asking(folder), "p").collect()  # another sample
    assert calls(folder) == 3 and not more[0].from_cache
    requests.prepass(spark, pages, cache, asking(folder), "another prompt")
    assert calls(folder) == 5
    assert requests.prepass(spark, pages.where("false"), str(tmp_path / "none"), asking(folder), "p").collect() == []


def test_a_book_without_an_answer_is_left_out(spark, tmp_path):
    pages, folder, cache = page_rows(spark, {"a": 2, "b": 2}), str(tmp_path / "calls"), str(tmp_path / "cache")
    bad = asking(folder, lambda images: "no object" if images[0].startswith(b"page a") else None)
    assert [r.book for r in requests.prepass(spark, pages, cache, bad, "p").collect()] == ["b"]
    assert sorted((r.book, r.from_cache) for r in requests.prepass(spark, pages, cache, asking(folder), "p").collect()) == [("a", False), ("b", True)]
    assert calls(folder) == 3
    numbered = pages.withColumn("page_no", F.substring("stem", 2, 9).cast("int") + 1)
    assert sorted((r.book, r.cover) for r in requests.covers(spark, numbered, cache, asking(folder), "cover").collect()) == [("a", 2), ("b", 2)]


def test_smoke_gate(spark, tmp_path):
    """Trial pages are paid for once; what is carried counts in the total; a book with a failed page goes no further."""
    pages, done, seen = page_rows(spark, {"cheap": 30, "dear": 30, "hurt": 30, "short": 4}), str(tmp_path / "done"), []

    def answer(image, prompt):
        book, n = image.decode().split()[1:]
        if book == "hurt" and n == "9":
            return {"md": None, "finish": None, "tokens_in": 5, "tokens_out": 0, "msg": "HTTP 403"}
        return {"md": "x", "finish": "stop", "tokens_in": 1_000_000 if book == "dear" else 1000, "tokens_out": 0, "msg": None}

    carried = spark.createDataFrame([("cheap", "0.09"), ("dear", "0.01")], "book string, cost_usd string").withColumn("cost_usd", F.col("cost_usd").cast("decimal(18,6)"))
    got = {r.book: r for r in smoke.smoke_gate(spark, pages, done, lambda est: est < 1, answer, carried=carried, tell=seen.append).collect()}
    told = {b: (r.status, r.ok, r.fail, r.remaining, float(r.est_full_usd), float(r.full_usd), float(r.total_usd)) for b, r in got.items()}
    assert told == {"cheap": ("full", 10, 0, 20, 0.0064, 0.0064, 0.0996), "dear": ("smoke", 10, 0, 20, 6.4, 0.0, 3.21), "hurt": ("partial", 9, 1, 21, told["hurt"][4], 0.0, told["hurt"][6]), "short": ("full", 4, 0, 0, 0.0, 0.0, 0.00128)}
    results = recognize.read_results(spark, done)
    assert results.where("outcome = 'ok'").groupBy("book", "stem").count().where("count > 1").isEmpty()
    assert {r.book: r["count"] for r in recognize.terminal(results).groupBy("book").count().collect()} == {"cheap": 30, "dear": 10, "hurt": 9, "short": 4}
    assert [e["ok"] for e in seen] == [33, 20] and seen[1]["open"] == 0
    later = {r.book: r.status for r in smoke.smoke_gate(spark, pages.where("book = 'dear'"), done, lambda est: est < 100, answer).collect()}
    assert later == {"dear": "full"} and recognize.terminal(recognize.read_results(spark, done)).where("book = 'dear'").count() == 30


def test_progress_of_passes_and_streams(spark, tmp_path):
    pages, told = page_rows(spark, {"a": 30}).union(page_rows(spark, {"b": 3}, b"")), []
    assert recognize.run_pass(spark, pages, str(tmp_path / "done"), batches=3, tell=told.append) == 0
    assert [t["batch"] for t in told] == [0, 1, 2] and sum(t["ok"] for t in told) == 33 and told[-1]["open"] == 0
    for n in (4, 5):
        page_rows(spark, {f"s{n}": n}).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        recognize.stream_new_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), pages.schema.simpleString()[7:-1].replace(":", " "), events=str(tmp_path / "events"))
    events = spark.read.schema(recognize.EVENTS).json(str(tmp_path / "events")).orderBy("batch").collect()
    assert [(e.batch, e.rows, e.ok, e.fail) for e in events] == [(0, 4, 4, 0), (1, 5, 5, 0)]


def test_a_pass_of_the_ledger_counts_once(spark, tmp_path):
    one = spark.createDataFrame([("a", "1.5"), ("a", "n/a"), ("b", "0"), ("b", "2")], "book string, cost_usd string")
    for entries, name in ((one, "x"), (one, "y"), (one.where("book = 'a'"), "x"), (one, "y")):
        cost.record_pass(entries, str(tmp_path / "ledger"), name)
    kept = cost.read_ledger(spark, str(tmp_path / "ledger"), "book string, cost_usd string")
    assert sorted((r.pass_id, r.book, float(r.cost_usd)) for r in kept.where("readable").collect()) == [("x", "a", 1.5), ("y", "a", 1.5), ("y", "b", 2.0)]
    assert sorted((r.pass_id, r.cost_usd) for r in kept.where("not readable").collect()) == [("x", "n/a"), ("y", "n/a")]
