"""Batches of books: the queue, slug lists, settings, passes, and what became of all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import schemas
from quire.functions.text import trimmed

#: A book is worked on at most so often in one batch.
PASSES = 2


def read_queue(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The books of a CSV file with a header: slug, title, authors, pdf_path; columns that it lacks are null. Quoted
    fields may hold commas and line ends. slug and pdf_path must be there; the limit takes the first rows."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.strip().lstrip("﻿"): c for c in found.columns}
    if lacking := {"slug", "pdf_path"} - set(names):
        raise ValueError(f"the queue lacks {', '.join(sorted(lacking))}")
    wanted = [f.split()[0] for f in schemas.QUEUE.split(", ")]
    queue = found.select(*(F.col(f"`{names[c]}`").alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in wanted))
    return queue.limit(limit) if limit is not None else queue


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """slug, log_no, text of log files named SLUG.NUMBER.log, each read whole."""
    found = spark.read.text(folder, wholetext=True).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.([0-9]+)\.log$", 0).alias("file"))
    part = lambda n: F.regexp_extract("file", r"^(.*)\.([0-9]+)\.log$", n)
    return found.where("file <> ''").select(part(1).alias("slug"), part(2).cast("long").alias("log_no"), F.col("value").alias("text"))


def listed_slugs(c: Column) -> Column:
    """The slugs of a comma-separated list, blanks around them dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: trimmed(x)), lambda x: x != "")


def with_text(queue: DataFrame, texts: DataFrame, slug: str = "slug") -> DataFrame:
    """The books of a queue that have a text; the others are skipped."""
    return queue.join(texts.select(slug, "md"), slug)


def settings(lines: DataFrame, line: str = "line") -> DataFrame:
    """key, value of lines KEY=VALUE: comments and lines without '=' are left out, the first '=' divides, one pair of
    quotes around the value goes. lines: order, line; the first of equal keys counts."""
    t = trimmed(F.col(line))
    parts = lines.withColumn("t_", t).where(F.col("t_").contains("=") & ~F.col("t_").startswith("#"))
    value = trimmed(F.regexp_extract("t_", r"(?s)^[^=]*=(.*)$", 1))
    plain = F.regexp_replace(F.regexp_replace(value, r"^[\"']+", ""), r"[\"']+$", "")
    found = parts.select("order", trimmed(F.substring_index("t_", "=", 1)).alias("key"), plain.alias("value")).where("key <> ''")
    first = F.row_number().over(Window.partitionBy("key").orderBy("order"))
    return found.withColumn("n_", first).where("n_ = 1").select("key", "value")


def added_settings(found: DataFrame, known: DataFrame) -> DataFrame:
    """Settings whose key is not known yet: what is set already is not overridden."""
    return found.join(known.select("key"), "key", "left_anti")


def batch_outcomes(runs: DataFrame, slug: str = "slug", passes: int = PASSES) -> DataFrame:
    """The pass at which each book ended, and how: output, unpaid, or given_up behind the last pass. runs: slug,
    pass_no (1-based), has_output, unpaid, secs. Time of later passes does not count."""
    end = F.when(F.col("has_output"), F.lit("output")).when(F.col("unpaid"), F.lit("unpaid")).when(F.col("pass_no") >= passes, F.lit("given_up"))
    ended = runs.where(F.col("pass_no") <= passes).withColumn("end_", end)
    first = F.min(F.when(F.col("end_").isNotNull(), F.col("pass_no"))).over(Window.partitionBy(slug))
    kept = ended.withColumn("first_", first).where(F.col("first_").isNull() | (F.col("pass_no") <= F.col("first_")))
    return kept.groupBy(slug).agg(F.count("*").cast("int").alias("passes"), F.coalesce(F.max("end_"), F.lit("open")).alias("outcome"), F.sum("secs").alias("secs"))


def rollup(results: DataFrame, queue: DataFrame, slug: str = "slug") -> DataFrame:
    """One row for the batch: books, done, total_secs, wall_secs (the longest lane), speedup, n429 and the books of the
    queue that were not started. results: slug, lane, label, secs, n429. Lanes are summed up first; only the names of
    books that were not started, a list by design, come together."""
    lanes = results.groupBy("lane").agg(F.count("*").alias("books"), F.count_if(F.col("label").startswith("DONE")).alias("done"), F.sum("secs").alias("secs"), F.sum("n429").alias("n429"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = lanes.agg(zero(F.sum("books")).alias("books"), zero(F.sum("done")).alias("done"), zero(F.sum("secs")).alias("total_secs"), zero(F.max("secs")).alias("wall_secs"), zero(F.sum("n429")).alias("n429"))
    idle = queue.select(slug).distinct().join(results.select(slug), slug, "left_anti").agg(F.array_sort(F.collect_list(slug)).alias("not_started"))
    speedup = F.when(F.col("wall_secs") > 0, F.col("total_secs") / F.col("wall_secs"))
    return total.crossJoin(idle).select("books", "done", "total_secs", "wall_secs", speedup.alias("speedup"), "n429", "not_started")  # one row each


def run_batch(slugs: Iterable[str], work: Callable[[str, int], tuple[bool, bool]], passes: int = PASSES) -> tuple[dict[str, str], list[str]]:
    """Books one after the other, each up to `passes` times until work(slug, pass_no) -> (has_output, unpaid) gives an
    output. Once credit is out no other book is started. Returns (outcomes, books not started)."""
    outcomes: dict[str, str] = {}
    left = list(slugs)
    while left:
        slug = left.pop(0)
        outcomes[slug] = "given_up"
        for n in range(1, passes + 1):
            has_output, unpaid = work(slug, n)
            if has_output or unpaid:
                outcomes[slug] = "output" if has_output else "unpaid"
                break
        if outcomes[slug] == "unpaid":
            break
    return outcomes, left
