"""Summaries of events and alerts: totals, top sources, hourly counts, forensics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import html_escape, preview
from duskwatch.schema import LINE_KEYS, with_line_keys

LATEST_ROWS = 200


def totals(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: number of events and of alerts."""
    kinds = events.select(F.lit(1).alias("e"), F.lit(0).alias("a")).unionAll(
        alerts.select(F.lit(0), F.lit(1))
    )
    return kinds.agg(
        F.count_if(F.col("e") == 1).alias("total_logs"),
        F.count_if(F.col("a") == 1).alias("total_anomalies"),
    )


def threat_level(counts: DataFrame) -> DataFrame:
    """Add ``threat_level`` to a :func:`totals` row."""
    logs, found = F.col("total_logs"), F.col("total_anomalies")
    share = F.try_divide(found, logs)
    return counts.withColumn(
        "threat_level",
        F.when((logs > 0) & ((share > 0.05) | (found > 50)), "HIGH")
        .when((logs > 0) & ((share > 0.01) | (found > 5)), "ELEVATED")
        .otherwise("LOW"),
    )


def top_actors(alerts: DataFrame, size: int = 5) -> DataFrame:
    """The addresses with the most alerts; blank ones take a place but are not shown."""
    return (
        alerts.where(F.col("ip_origen").isNotNull())
        .groupBy("ip_origen")
        .agg(F.count(F.lit(1)).alias("hits"))
        .orderBy(F.desc("hits"), "ip_origen")
        .limit(size)
        .where(F.trim("ip_origen") != "")
    )


def hourly_intensity(events: DataFrame) -> DataFrame:
    """Events per hour from the first to the last hour, empty hours included."""
    hour = F.make_timestamp_ntz(
        F.year("datetime"),
        F.month("datetime"),
        F.day("datetime"),
        F.hour("datetime"),
        F.lit(0),
        F.lit(0),
    )
    counts = (
        events.where(F.col("datetime").isNotNull())
        .groupBy(hour.alias("datetime"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    span = counts.agg(F.min("datetime").alias("lo"), F.max("datetime").alias("hi"))
    hours = span.where(F.col("lo").isNotNull()).select(
        F.explode(F.sequence("lo", "hi", F.expr("interval 1 hour"))).alias("datetime")
    )
    return hours.join(counts, "datetime", "left").select(
        "datetime", F.coalesce("events", F.lit(0)).alias("events")
    )


def forensic_view(events: DataFrame, alerts: DataFrame, size: int = LATEST_ROWS) -> DataFrame:
    """The last lines of the log, each with the alert of its moment and address.

    If a moment and address have several alerts, the last one counts.
    """
    df = with_line_keys(events)
    latest = df.orderBy(*[F.desc(c) for c in LINE_KEYS]).limit(size)
    order = F.struct(*[c for c in ["usuario", "accion", "status"] if c in alerts.columns])
    # At most ``size`` moments, a fixed number, so the small side can be sent around.
    wanted = F.broadcast(latest.select("datetime", "ip_origen").distinct())
    known = (
        alerts.join(wanted, ["datetime", "ip_origen"])
        .groupBy("datetime", "ip_origen")
        .agg(F.max_by(F.struct("rule", "severity"), order).alias("alert"))
    )
    time_text = F.col("timestamp") if "timestamp" in df.columns else F.lit(None)
    return latest.join(known, ["datetime", "ip_origen"], "left").select(
        *LINE_KEYS,
        "status",
        F.coalesce(F.col("datetime").cast("string"), time_text).alias("time_text"),
        alert_label(F.col("alert.rule")).alias("label"),
        F.upper("alert.severity").alias("severity"),
        preview(F.coalesce("accion", F.lit("None"))).alias("action_preview"),
        html_escape(F.coalesce("ip_origen", F.lit(""))).alias("source"),
    )


def alert_label(rule: Column) -> Column:
    return F.when(rule.isNotNull(), F.concat(F.lit("["), F.upper(rule), F.lit("]"))).otherwise("")
