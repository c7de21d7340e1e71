"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, running_sums, word_count

#: Hashes have 60 bits; their first BUCKET_BITS deal a source's rows into buckets that are summed before any is sorted.
HASH_DIGITS, BUCKET_BITS = 15, 12


def row_hash(seed: str, *cols: Column) -> Column:
    """60 bits of an md5 as a long."""
    text = F.concat_ws("|", F.lit(seed), *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def water_fill(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sizes (key, weight long, source_size long) -> with target double.

    All sizes together are shared by weight; a source whose share is above max_epochs times its size is clamped there
    and the excess shared again by weight, until none is above. Ordered by cap over weight the clamped sources come
    first, and a source is clamped exactly if its share of what those before it leave is above its cap; so running
    sums over the source table (a row per source) replace the rounds. Sums are integers, so reruns agree to the bit.
    """
    capped = sizes.withColumn("cap", F.col("source_size") * max_epochs)
    run = running_sums(capped, [F.col("cap") / F.col("weight"), F.col("key")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    whole = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weights")).first()
    left, weights = F.lit(whole.total) - F.col("cap_before"), F.lit(whole.weights) - F.col("weight_before")
    step = cut(run.withColumn("clamped", left * F.col("weight") > F.col("cap") * weights))
    sums = step.agg(F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))), F.lit(0)).alias("free")).first()
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.lit(whole.total - sums.given)).cast("double") / F.lit(sums.free))
    return step.select("key", "weight", "source_size", target.alias("target"))


def ranked_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """sources (key, source_size) -> with a weight each: in order of code point, null last, the weights repeat."""
    ranked = running_sums(sources, [F.col("key").asc_nulls_last()], {"rank": F.lit(1)})
    return ranked.select("key", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight"))


def extra_cuts(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (key, source_size, target) -> (key, source_size, target, times, cut, tied, some).

    times is the number of whole repetitions; the rows with a hash below `cut` (none if null) come once more, and of the
    `tied` rows that have this very hash the first `some` (all if null). That brings the source within half a row of its
    target; a source that whole repetitions fill has no cut, so that not even its empty rows come once more. Rows are
    summed by bucket of the hash, the bucket in which the target falls is found from those sums, and only that bucket's
    rows (one in 4096) are ordered.
    """
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    need = targets.withColumn("times", times).withColumn("need", F.col("target") - F.col("times") * F.col("source_size"))
    shift = HASH_DIGITS * 4 - BUCKET_BITS
    sums = rows.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
    run = Window.partitionBy("key").orderBy("bucket")
    at = sums.withColumn("upto", F.sum("size").over(run)).withColumn("below", F.col("upto") - F.col("size")).withColumnRenamed("key", "k")
    edge = need.join(at, need.key.eqNullSafe(at.k) & (F.col("below") <= F.col("need")), "left").groupBy("key").agg(F.max_by(F.struct("bucket", "below"), "bucket").alias("edge"))
    edge = edge.select(F.col("key").alias("k"), "edge.bucket", "edge.below")
    need = need.join(edge, need.key.eqNullSafe(edge.k), "left").drop("k")
    mine = need.select(F.col("key").alias("k"), F.col("bucket").alias("b"), "below", "need")
    inside = rows.join(mine, rows.key.eqNullSafe(mine.k) & (F.shiftright("h", shift) == F.col("b")))
    # Rows of one hash have one text and one size.
    ties = inside.groupBy("key", "h").agg(F.sum("size").alias("size"), F.max("size").alias("each"), F.count("*").alias("tied"), F.first("below").alias("below"), F.first("need").alias("need"))
    before = F.col("below") + F.sum("size").over(Window.partitionBy("key").orderBy("h")) - F.col("size")
    fit = F.floor((2 * (F.col("need") - F.col("before")) + F.col("each")) / (2 * F.col("each")))
    some = F.when(F.col("each") > 0, F.least(F.col("tied"), fit)).when(F.col("before") <= F.col("need"), F.col("tied"))
    taken = ties.withColumn("before", before).withColumn("some", some.cast("long")).where("some > 0")
    inner = taken.groupBy("key").agg(F.max(F.struct("h", "tied", "some")).alias("inner")).withColumnRenamed("key", "k")
    out = need.join(inner, need.key.eqNullSafe(inner.k), "left")
    whole_buckets = F.when(F.col("bucket").isNotNull(), F.shiftleft("bucket", shift) - 1)
    return out.select("key", "source_size", "target", "times", F.when(F.col("need") > 0, F.coalesce("inner.h", whole_buckets)).alias("cut"), F.coalesce("inner.tied", F.lit(0)).alias("tied"), "inner.some")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows, plan): a row (doc_id, key, size, h) per row of docs, and the plan of extra_cuts() per source."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("key"), word_count(F.col(text)).alias("size"), row_hash(seed, F.col(doc_id), F.col(text)).alias("h")))
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    return rows, cut(extra_cuts(rows, water_fill(ranked_weights(cut(sizes), weights), max_epochs)))


def beside(plan: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """The stored plan, keyed by k, for a join by source. A plan measured to be small is broadcast, so that texts of a
    hot source stay where they are; beyond that Spark shuffles and splits the hot source."""
    plan = plan.withColumnRenamed("key", "k")
    told = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.col("k").cast("string"))), F.lit(0)).alias("chars")).first()
    return F.broadcast(plan) if 64 * told.n + 4 * told.chars <= most_bytes else plan


def with_times(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with key and h) with their source's plan and `often`: how many times a row comes.

    Where a cut falls among rows of one hash, which repeat one document, these are stored and numbered by the task that
    read them, so any number of them is dealt with in many tasks.
    """
    told = rows.join(beside(plan), rows.key.eqNullSafe(F.col("k"))).drop("k")
    split = F.coalesce((F.col("h") == F.col("cut")) & (F.col("some") < F.col("tied")), F.lit(False))
    more = F.coalesce((F.col("h") <= F.col("cut")).cast("long"), F.lit(0))
    if plan.where("some < tied").isEmpty():
        return told.withColumn("often", F.col("times") + more)
    tied = cut(told.where(split).withColumn("task", F.spark_partition_id()))
    counts = tied.groupBy("key", "task").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("task")) - F.col("n")
    counts = counts.select(F.col("key").alias("k"), F.col("task").alias("t"), upto.alias("upto"))  # a row for each task and source
    place = F.col("upto") + F.row_number().over(Window.partitionBy("key", "task").orderBy("h"))
    tied = tied.join(counts, tied.key.eqNullSafe(counts.k) & (tied.task == counts.t)).withColumn("often", F.col("times") + (place <= F.col("some")).cast("long"))
    return told.where(~split).withColumn("often", F.col("times") + more).unionByName(tied.drop("k", "t", "task", "upto"))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    Sizes are words; a null text has none. A null source is a source of its own, last in order. Rows with null or
    repeated ids are drawn by their text as well, and of rows that repeat a document as many come once more as the
    target needs. An empty table gives no rows, and a source without words has target 0. No row comes more than
    max_epochs times.
    """
    rows, plan = mix_plan(docs, **options)
    return with_times(rows, plan).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("often")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns as they were; rows as in mix_sizes()."""
    _, plan = mix_plan(docs, seed=seed, doc_id=doc_id, text=text, source=source, **options)
    row = docs.select(F.struct("*").alias("row"), F.col(source).alias("key"), row_hash(seed, F.col(doc_id), F.col(text)).alias("h"))
    return with_times(row, plan).where("often > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("often")))).select("row.*")


MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY key ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM rows GROUP BY key),
capped AS (SELECT *, 3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
step AS (
  SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
            > cap * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS clamped
  FROM capped WINDOW o AS (ORDER BY cap / weight, key)),
targets AS (
  SELECT key, source_size, CASE WHEN clamped THEN CAST(cap AS DOUBLE)
         ELSE CAST(weight * (total - coalesce(sum(cap) FILTER (WHERE clamped) OVER (), 0)) AS DOUBLE)
              / CAST(sum(weight) FILTER (WHERE NOT clamped) OVER () AS DOUBLE) END AS target
  FROM step),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM targets),
ties AS (
  SELECT doc_id, size, key, sum(size) OVER (PARTITION BY key ORDER BY h, nr) AS upto
  FROM (SELECT *, row_number() OVER (PARTITION BY key, h) AS nr FROM rows))
SELECT r.doc_id, r.size, p.source_size, p.target,
       CAST(r.size * (p.times + CASE WHEN p.target > p.times * p.source_size AND 2 * r.upto - r.size <= 2 * (p.target - p.times * p.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ties r JOIN plan p ON r.key IS NOT DISTINCT FROM p.key
"""
