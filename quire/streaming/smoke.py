"""A trial before the whole: the first open pages of each book tell what the rest would cost."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import natural_key
from quire.operators import cost
from quire.streaming.recognize import Recognizer, offline_stub, open_pages, read_results, recognize, run_pass, write_results

#: Pages of a book that are tried.
TRIAL = 10


def smoke_gate(spark: SparkSession, pages: DataFrame, done_path: str, approve: Callable[[Column], Column], recognizer: Recognizer = offline_stub, trial: int = TRIAL, carried: DataFrame | None = None, model: str = cost.DEFAULT_MODEL, tell: Callable[[dict], None] | None = None, **options) -> DataFrame:
    """One row per book of pages (book, stem, content, prompt): status, ok, blank, fail and smoke_usd of the trial,
    remaining pages, est_full_usd, full_usd and total_usd.

    The first `trial` open pages of each book are recognised and their results kept, so that no page is paid for twice.
    A book of which a page failed stops as `partial`. What the rest would cost, at the price that the trial's good pages
    had, is put to approve(): a book that it does not pass stops as `smoke`, others are done whole (`full`). carried
    (book, cost_usd) is what was spent on the books before, by the pre-pass for instance; it counts in total_usd only.
    """
    passes = uuid.uuid4().hex
    order = Window.partitionBy("book").orderBy(natural_key(F.col("stem")), "stem")
    todo = open_pages(pages, read_results(spark, done_path))
    first = todo.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= trial).drop("n_")
    got = write_results(recognize(first, recognizer, **options), done_path, f"{passes}-trial")
    if tell:
        tell({"pass_id": f"{passes}-trial", "batch": 0, "batches": 1} | got)

    def spent(pass_id: str, name: str) -> DataFrame:
        rows = read_results(spark, done_path).where(F.col("pass_id") == pass_id).withColumn("model", F.lit(model))
        each = cost.priced(rows, cost.price_table(spark))
        counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("ok", "blank")]
        failed = F.count_if(~F.col("outcome").isin("ok", "blank")).alias("fail")
        return each.groupBy("book").agg(*counts, failed, F.sum("cost_usd").cast("decimal(28,6)").alias(name))

    left = open_pages(pages, read_results(spark, done_path)).groupBy("book").agg(F.count("*").alias("remaining"))
    tried = pages.select("book").distinct().join(spent(f"{passes}-trial", "smoke_usd"), "book", "left").join(left, "book", "left").fillna(0, ["ok", "blank", "fail", "remaining"])
    usd = F.coalesce("smoke_usd", F.lit(0).cast("decimal(28,6)"))
    judged = tried.withColumn("smoke_usd", usd).withColumn("est_full_usd", cost.smoke_estimate(F.col("smoke_usd"), F.col("ok"), F.col("remaining")))
    status = F.when(F.col("fail") > 0, "partial").when(F.coalesce(approve(F.col("est_full_usd")), F.lit(False)), "full").otherwise("smoke")
    judged = judged.withColumn("status", status).persist()
    try:
        judged.count()  # settled before the rest is recognised
        rest = pages.join(judged.where("status = 'full' and remaining > 0").select("book"), "book", "left_semi")
        run_pass(spark, rest, done_path, recognizer, tell=tell, pass_id=f"{passes}-full", **options)
        whole = judged.join(spent(f"{passes}-full", "full_usd").select("book", "full_usd"), "book", "left")
        if carried is not None:
            whole = whole.join(carried.select("book", F.col("cost_usd").alias("carried_")), "book", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(28,6)")
        total = zero("smoke_usd") + zero("full_usd") + (zero("carried_") if carried is not None else F.lit(0).cast("decimal(28,6)"))
        rows = whole.select("book", "status", "ok", "blank", "fail", "smoke_usd", "remaining", "est_full_usd", zero("full_usd").alias("full_usd"), total.cast("decimal(28,6)").alias("total_usd"))
        held = rows.persist()  # what was judged outlives this call
        held.count()
        return held
    finally:
        judged.unpersist()
