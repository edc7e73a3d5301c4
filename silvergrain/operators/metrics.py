"""Operational metrics and alert rules over event tables: quantiles, increases, ratios and conditions that last."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str = "ts", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """events with window_start; sliding windows if ``slide`` is given."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withColumn("_w", span).withColumn("window_start", F.col("_w.start")).drop("_w")


def quantile(events: DataFrame, by: list[str], value: str, q: float, width: str = "5 minutes") -> DataFrame:
    """Exact quantile of the raw values in each window."""
    return windowed(events, width=width).groupBy("window_start", *by).agg(F.round(F.percentile(value, q), 6).alias("value"))


def bucket_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """Quantile from cumulative buckets (le, n), interpolated inside the bucket, the last bound for the open one."""
    order = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    whole = Window.partitionBy(*by)
    # counts of later buckets hold those of earlier ones, even where they were sampled a little earlier
    level = buckets.withColumn("n", F.max("n").over(order))
    own = level.withColumn("_total", F.max("n").over(whole)).withColumn("_lo", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("_before", F.coalesce(F.lag("n").over(order), F.lit(0)))
    hit = own.where(F.col("n") >= F.col("_total") * q).groupBy(*by).agg(F.min(F.struct(F.col("le").isNull().alias("open"), "le", "_lo", "_before", "n", "_total")).alias("b"))
    inside = F.col("b._lo") + (F.col("b.le") - F.col("b._lo")) * F.try_divide(F.col("b._total") * q - F.col("b._before"), F.col("b.n") - F.col("b._before"))
    return hit.select(*by, F.coalesce(inside, F.col("b._lo")).alias("value"))


def increase(events: DataFrame, by: list[str], condition: Column, width: str = "5 minutes") -> DataFrame:
    """How many events meet the condition in each window."""
    return windowed(events, width=width).groupBy("window_start", *by).agg(F.count_if(condition).alias("value"))


def counter_increase(samples: DataFrame, by: list[str], width: str = "5 minutes", extrapolate: bool = True) -> DataFrame:
    """(window_start, by, value): how much a sampled counter (by, ts, value) rose in each window; null where a window has fewer than two samples.

    A sample below the one before it is a reset, after which the counter began at 0. What lies between the first and the last sample is
    stretched to the edges of the window: by the distance to each edge, or by half the mean distance of samples where that edge is more than
    1.1 mean distances away, and at the start by no more than takes the counter back to 0. Samples without a time or value are left out, and
    of samples of one series and time the greatest counts.
    """
    own = windowed(samples.where("ts IS NOT NULL AND value IS NOT NULL").groupBy(*by, "ts").agg(F.max("value").alias("value")), width=width)
    group = ["window_start", *by]
    before = F.lag("value").over(Window.partitionBy(*group).orderBy("ts"))
    rise = F.when(F.col("value") < before, F.col("value")).otherwise(F.col("value") - before)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    sums = own.withColumn("_rise", rise).groupBy(*group).agg(F.sum("_rise").alias("_rise"), F.count(F.lit(1)).alias("_n"), F.min(at).alias("_from"), F.max(at).alias("_to"), F.min_by("value", "ts").alias("_first"))
    start = F.unix_micros(F.col("window_start").cast("timestamp")) / 1e6
    span = F.col("_to") - F.col("_from")
    gap = F.try_divide(span, F.col("_n") - 1)
    near = lambda edge: F.when(edge >= gap * 1.1, gap / 2).otherwise(edge)
    lead, tail = near(F.col("_from") - start), near(start + F.lit(_seconds(width)) - F.col("_to"))
    lead = F.least(lead, F.when(F.col("_rise") > 0, F.try_divide(F.col("_first") * span, F.col("_rise"))))  # least passes over null
    whole = F.try_divide(F.col("_rise") * (span + lead + tail), span) if extrapolate else F.col("_rise")
    return sums.select(*group, F.round(F.when(F.col("_n") > 1, whole), 6).alias("value"))


def counter_rate(samples: DataFrame, by: list[str], width: str = "5 minutes") -> DataFrame:
    """As ``counter_increase``, a second."""
    return counter_increase(samples, by, width).withColumn("value", F.round(F.col("value") / _seconds(width), 9))


def histogram_quantile(samples: DataFrame, by: list[str], q: float, width: str = "5 minutes") -> DataFrame:
    """(window_start, by, value): quantile of a histogram kept as cumulative counters (by, le, ts, value), from the rate of each bucket; null where none rose."""
    rates = counter_rate(samples, [*by, "le"], width).where("value IS NOT NULL")
    found = bucket_quantile(rates.withColumnRenamed("value", "n"), ["window_start", *by], q)
    some = rates.groupBy("window_start", *by).agg(F.max("value").alias("_most"))
    return some.join(found, ["window_start", *by], "left").select("window_start", *by, F.round(F.when(F.col("_most") > 0, F.col("value")), 6).alias("value"))


def _seconds(width: str) -> float:
    return pd.Timedelta(width).total_seconds()


def ratio(events: DataFrame, by: list[str], top: Column, bottom: Column, width: str = "5 minutes") -> DataFrame:
    """Events that meet one condition over those that meet another, null where none does."""
    rate = F.try_divide(F.count_if(top).cast("double"), F.count_if(bottom).cast("double"))
    return windowed(events, width=width).groupBy("window_start", *by).agg(F.round(rate, 9).alias("value"))


def lasting(values: DataFrame, by: list[str], condition: Column, windows: int, width_seconds: int) -> DataFrame:
    """Windows at whose end the condition has held for so many windows in a row; a missing window breaks the row."""
    hit = values.where(condition).withColumn("_n", F.unix_timestamp("window_start") / width_seconds)
    order = Window.partitionBy(*by).orderBy("window_start") if by else Window.partitionBy(F.lit(1)).orderBy("window_start")
    island = hit.withColumn("_i", F.col("_n") - F.row_number().over(order))
    inside = Window.partitionBy(*by, "_i").orderBy("window_start")
    return island.withColumn("held", F.row_number().over(inside)).where(F.col("held") >= windows).drop("_n", "_i")
