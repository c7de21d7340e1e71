"""Progress events as lines of JSON, and the summary of each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_line(kind: Column, *payload: Column) -> Column:
    """One event as JSON: its kind, then its payload's fields; fields without a value are left out."""
    return F.to_json(F.struct(kind.alias("event"), *payload))


def run_summary(events: DataFrame, run: list[str], order: str = "seq") -> DataFrame:
    """A row per run with ok, blank, fail, skipped, total and cost_usd.

    events: run, order, event, payload (JSON). The last `start` tells total and skipped, the last `done` the rest;
    what none of them tells is zero. Both are picked with map-side combine, so a run of many events is no hot group.
    """
    last = lambda kind: F.max_by("payload", F.when(F.col("event") == kind, F.col(order)))
    told = events.groupBy(*run).agg(last("start").alias("start_"), last("done").alias("done_"))
    number = lambda c, name, kind: F.coalesce(F.get_json_object(c, f"$.{name}").try_cast(kind), F.lit(0).cast(kind)).alias(name)
    done = [number("done_", n, "bigint") for n in ("ok", "blank", "fail")]
    start = [number("start_", n, "bigint") for n in ("skipped", "total")]
    return told.select(*run, *done, *start, number("done_", "cost_usd", "decimal(18,6)"))


def summary_json(stage: Column, status: Column, pages: Column, cost_usd: Column, **paths: Column) -> Column:
    """The summary as one JSON object; paths that are null are left out."""
    told = F.struct(*(c.alias(n) for n, c in paths.items())) if paths else F.from_json(F.lit("{}"), "x string")
    return F.to_json(F.struct(status.alias("status"), stage.alias("stage"), pages.alias("pages"), F.round(cost_usd, 4).alias("cost_usd"), told.alias("paths")))
