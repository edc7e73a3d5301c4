"""Report on the use of a service from its log of requests, with alerts for latencies that stay high.

    python jobs/usage_report.py --events PATH --output PATH [--config jobs/usage_report.json]

Events (ts, event_type, value; the value is a latency) become rows (day, metric, window_start, event_type, value): ``n`` and ``mean`` of
each window and type, its quantiles (``p50``...), and a row ``alert:<rule>`` where a rule's quantile has been above its limit for as many
windows in a row as the rule says. The output is partitioned by day and metric.

With ``from_day`` and ``to_day`` (the first and the last, both reported) only those days are read and written anew, besides as many windows before them as
rules look back; a day that has been reported before is replaced, so a repeated run gives the same. Events without a time are left out, those without a value count in ``n`` alone.
"""

from __future__ import annotations

import logging
import sys
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs import common
from silvergrain.operators import metrics

log = logging.getLogger("usage_report")
RULES = [{"name": "slow", "quantile": "p95", "above": 75.0, "windows": 3}]
SETTINGS = {"window_minutes": 60, "resolution": 0.01, "quantiles": [50, 95, 99], "rules": RULES, "from_day": None, "to_day": None}
REPORT = "window_start timestamp, event_type string, value double, day date, metric string"
BY = ["window_start", "event_type"]


def measured(events: DataFrame, minutes: int, resolution: float, quantiles: list[int]) -> DataFrame:
    """(window_start, event_type, metric, value). A quantile is the upper end of the bin of ``resolution`` that holds it, so counts of bins are all that is gathered."""
    own = metrics.windowed(events.where("ts IS NOT NULL"), width=f"{minutes} minutes").select(*BY, "value", F.floor(F.col("value") / resolution).alias("bin"))
    bins = own.groupBy(*BY, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    upward = Window.partitionBy(*BY).orderBy("bin")
    known = F.when(F.col("bin").isNotNull(), F.col("n")).otherwise(0)
    placed = bins.select("*", F.sum(known).over(upward).alias("reached"), F.sum(known).over(Window.partitionBy(*BY)).alias("valued"))
    end = F.round((F.col("bin") + 1) * resolution, 6)
    reaches = lambda q: F.when(F.col("bin").isNotNull() & (F.col("reached") * 100 >= F.col("valued") * q), end)
    wide = placed.groupBy(*BY).agg(F.sum("n").cast("double").alias("n"), F.round(F.try_divide(F.sum("total"), F.max("valued")), 6).alias("mean"), *(F.min(reaches(q)).alias(f"p{q}") for q in quantiles))
    names = ["n", "mean", *(f"p{q}" for q in quantiles)]
    return wide.unpivot(BY, names, "metric", "value").where("value IS NOT NULL")


def alerts(found: DataFrame, rules: list[dict], minutes: int) -> DataFrame:
    """Rows of the windows at whose end a rule has held for as long as it says."""
    out = None
    for rule in rules:
        own = found.where(F.col("metric") == rule["quantile"])
        held = metrics.lasting(own, ["event_type"], F.col("value") > rule["above"], rule["windows"], minutes * 60)
        part = held.select(*BY, F.lit(f"alert:{rule['name']}").alias("metric"), "value")
        out = part if out is None else out.unionByName(part)
    return found.limit(0) if out is None else out


def run(spark: SparkSession, events: str, output: str, window_minutes: int = 60, resolution: float = 0.01, quantiles: list[int] = (50, 95, 99), rules: list[dict] = RULES, from_day: str | None = None, to_day: str | None = None) -> None:
    """Write the report of the days asked for, or of all."""
    own = spark.read.parquet(events).select("ts", "event_type", F.col("value").cast("double").alias("value"))
    back = max([0, *(r["windows"] for r in rules)]) * window_minutes
    if from_day:
        own = own.where(F.col("ts") >= F.expr(f"timestamp'{from_day} 00:00:00' - make_interval(0, 0, 0, 0, 0, {int(back)}, 0)"))
    if to_day:
        own = own.where(F.col("ts") < F.date_add(F.lit(to_day).cast("date"), 1).cast("timestamp"))
    found = measured(own, window_minutes, resolution, list(quantiles))
    rows = found.unionByName(alerts(found, rules, window_minutes)).withColumn("day", F.to_date("window_start"))
    rows = rows.where(F.col("day") >= from_day) if from_day else rows
    rows.select(*BY, "value", "day", "metric").repartition("day").write.partitionBy("day", "metric").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(output)
    kept = read(spark, output)
    kept = kept.where(F.col("day") >= from_day) if from_day else kept
    kept = kept.where(F.col("day") <= to_day) if to_day else kept
    counts = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("metric").startswith("alert:")).alias("alerts"), F.countDistinct("day").alias("days")).first()
    log.info("read %d events of %s, wrote %d rows (%d alerts) of %d days to %s", own.count(), events, counts["n"], counts["alerts"], counts["days"], output)


def read(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


if __name__ == "__main__":
    common.main("usage_report", {"events": "Parquet of requests", "output": "folder of the report"}, run, SETTINGS)
