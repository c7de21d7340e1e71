"""Requests for groups of pages, answered once: what a model said of some images is kept by their content.

The context of a book (from a sample of its pages) and its cover are asked for in this way.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import natural_key
from quire.operators import context, cost
from quire.operators.pages import context_sample

#: What is kept of a request: its content's digest, what was said, and what that cost once.
CACHE = "digest string, answer string, tokens_in long, tokens_out long"
#: images in order, prompt -> md (the answer), tokens_in, tokens_out, msg (null if all went well)
Model = Callable[[list[bytes], str], dict]
#: A cover is looked for among so many first pages.
COVER_PAGES = 12


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Digests with their answer, one each; none if nothing has been kept yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.groupBy("digest").agg(F.min(F.struct("answer", "tokens_in", "tokens_out")).alias("a")).select("digest", "a.*")


def asked(spark: SparkSession, images: DataFrame, cache: str, model: Model, prompt: str, valid: Callable[[Column], Column]) -> DataFrame:
    """book, answer, tokens_in, tokens_out, from_cache for each book of images (book, place, content) with an answer.

    A book's images, few by contract, are one request. What an earlier call was told of the same images and prompt is
    not asked again and costs nothing, nor are two books of the same images asked for twice. An answer that is not
    valid, or an error, is not kept: its books are left out, and the next call asks again. Requests are made while the
    cache is written, and it is read from there: using the result asks nothing again. Run it without speculation.
    """
    sums = F.transform(F.array_sort(F.collect_list(F.struct("place", F.sha2("content", 256).alias("sha")))), lambda x: x["sha"])
    digests = images.groupBy("book").agg(F.sha2(F.concat_ws("\\n", F.lit(prompt), sums), 256).alias("digest")).persist()
    known = read_cache(spark, cache).select("digest", F.lit(True).alias("from_cache"))
    try:
        wanted = digests.join(known, "digest", "left_anti").groupBy("digest").agg(F.min("book").alias("book"))
        # Which digests were known is settled before new ones are written, to a folder of their own: what is held of a
        # folder is forgotten once that is written to.
        before = digests.join(known, "digest", "left").select("book", "digest", F.coalesce("from_cache", F.lit(False)).alias("from_cache")).persist()
        before.count()

        def ask(group: pd.DataFrame) -> pd.DataFrame:
            got = model([bytes(c) if c is not None else b"" for c in group.sort_values("place")["content"]], prompt)
            return pd.DataFrame({"digest": [group["digest"].iloc[0]], "answer": [None if got["msg"] else got["md"]], "tokens_in": [got["tokens_in"] or 0], "tokens_out": [got["tokens_out"] or 0]})

        said = images.join(wanted, "book").select("digest", "place", "content").groupBy("digest").applyInPandas(ask, CACHE)
        said.where(F.coalesce(valid(F.col("answer")), F.lit(False))).write.parquet(f"{cache}/run={uuid.uuid4().hex}")
    finally:
        digests.unpersist()
    once = lambda c: F.when(F.col("from_cache"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    return before.join(read_cache(spark, cache), "digest").select("book", "answer", once("tokens_in"), once("tokens_out"), "from_cache")


def prepass(spark: SparkSession, pages: DataFrame, cache: str, model: Model, prompt: str) -> DataFrame:
    """book, context, block, tokens_in, tokens_out, cost_usd, from_cache of each book that a sample of its pages gives a
    context for; the others are left out, for they must not be recognised without. pages: book, stem, content."""
    order = [natural_key(F.col("stem")), F.col("stem")]
    sample = context_sample(pages.select("book", "stem", "content"), "book", order)
    images = sample.select("book", F.struct(*order).alias("place"), "content")
    got = asked(spark, images.withColumn("place", F.to_json(F.col("place"))), cache, model, prompt, lambda a: context.parse(a).isNotNull())
    told = cost.priced(got.withColumn("model", F.lit(cost.DEFAULT_MODEL)), cost.price_table(spark))
    return told.withColumn("context", context.parse(F.col("answer"))).select("book", "context", context.render(F.col("context")).alias("block"), "tokens_in", "tokens_out", "cost_usd", "from_cache")


def covers(spark: SparkSession, pages: DataFrame, cache: str, model: Model, prompt: str, most: int = COVER_PAGES) -> DataFrame:
    """book, cover (the number of the page, null if the answer names none), reason, from_cache. pages: book, page_no,
    content; the first `most` pages are looked at."""
    first = pages.where(F.col("page_no") <= most)
    got = asked(spark, first.select("book", F.col("page_no").alias("place"), "content"), cache, model, prompt, lambda a: a.isNotNull())
    n = first.groupBy("book").agg(F.max("page_no").alias("n"))
    return got.join(n, "book").select("book", context.cover_page(F.col("answer"), F.col("n")).alias("cover"), context.safe_reason(F.col("answer")).alias("reason"), "from_cache")
