"""Costs: prices, ledger, estimates. Money is DECIMAL; a price is dollars for a million tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.pages import with_default

# Models with their prices for tokens in and out, and the estimate for a page.
PRICES = (("qwen/qwen3.7-plus", "0.32", "1.28"), ("qwen/qwen3.7-flash", "0.03", "0.13"), ("google/gemini-3.1-pro-preview", "2.5", "10.0"))
DEFAULT_MODEL, PAGE_ESTIMATE = "qwen/qwen3.7-plus", "0.004"


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    rows = spark.createDataFrame([*prices], "model string, price_in string, price_out string")
    return rows.select("model", F.col("price_in").cast("decimal(10,4)").alias("price_in"), F.col("price_out").cast("decimal(10,4)").alias("price_out"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Dollars, exactly: tokens times price over a million, with six places."""
    exact = tokens_in.cast("decimal(18,0)") * price_in + tokens_out.cast("decimal(18,0)") * price_out
    return (exact / F.lit(1_000_000)).cast("decimal(18,6)")


def priced(rows: DataFrame, prices: DataFrame, model: str = "model", default: str = DEFAULT_MODEL) -> DataFrame:
    """rows with price_in, price_out and cost_usd; unknown models cost what the default does."""
    known = with_default(rows, prices, model, default, ["price_in", "price_out"])
    return known.withColumn("cost_usd", token_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))


def ledger_totals(ledger: DataFrame, key: list[str], cost: str = "cost_usd") -> DataFrame:
    """Entries that cost something, and their sum; what is no number is left out."""
    c = F.col(cost).try_cast("decimal(18,6)")
    return ledger.withColumn("c_", c).where("c_ > 0").groupBy(*key).agg(F.count("*").alias("entries"), F.sum("c_").cast("decimal(28,6)").alias("total_usd"))


def append_ledger(entries: DataFrame, path: str) -> None:
    """Appends what costs something; entries without a readable cost go to a table beside it."""
    c = F.col("cost_usd").try_cast("decimal(18,6)")
    entries.where(c > 0).withColumn("cost_usd", c).write.mode("append").parquet(f"{path}/entries")
    entries.where(c.isNull()).write.mode("append").parquet(f"{path}/quarantine")


def record_pass(entries: DataFrame, path: str, pass_id: str) -> None:
    """Writes what one pass cost, once: the same pass written again takes the place of what it wrote before. Entries
    with and without a readable cost go with one commit; the latter are kept aside, what cost nothing is left out."""
    c = F.col("cost_usd").try_cast("decimal(18,6)")
    told = entries.where(c.isNull() | (c > 0)).withColumns({"pass_id": F.lit(pass_id), "readable": c.isNotNull()})
    told.withColumn("cost_usd", F.col("cost_usd").cast("string")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pass_id", "readable").parquet(path)


def read_ledger(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The entries of all passes that record_pass() wrote: `columns` (with cost_usd a string), pass_id and readable."""
    return spark.read.schema(f"{columns}, pass_id string, readable boolean").parquet(path)


def estimates(pages: DataFrame, key: list[str]) -> DataFrame:
    """Before a run: pages to do, skipped, all, and the dollars at the fixed estimate. pages: done BOOLEAN."""
    todo = F.count_if(~F.col("done"))
    return pages.groupBy(*key).agg(todo.alias("todo"), F.count_if("done").alias("skipped"), F.count("*").alias("total"), (todo.cast("decimal(18,0)") * F.lit(PAGE_ESTIMATE).cast("decimal(6,3)")).cast("decimal(18,3)").alias("estimate_usd"))


def smoke_estimate(smoke_cost: Column, ok: Column, remaining: Column) -> Column:
    """The rest at what the trial's good pages cost each, or at the fixed estimate if none was good. What each cost is
    not rounded before it is multiplied."""
    n = remaining.cast("decimal(12,0)")
    rest = smoke_cost.cast("decimal(20,6)") * n / F.nullif(ok.cast("decimal(12,0)"), F.lit(0).cast("decimal(12,0)"))
    return F.coalesce(rest, F.lit(PAGE_ESTIMATE).cast("decimal(6,3)") * n).cast("decimal(28,9)")
