"""Features of an event for anomaly detection: the same for training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import adler32, batch_entropy
from duskwatch.schema import LINE_KEYS, with_line_keys
from duskwatch.scratch import materialize

from .windows import SOURCE, trailing_counts

# Feature columns in the order the model reads them.
FEATURES = [
    "hour",
    "ip_encoded",
    "status_val",
    "fail_ratio_per_ip",
    "unique_users_per_ip",
    "requests_per_minute",
    "url_entropy",
    "unique_urls_per_ip",
]
MIN_ROWS_FOR_RATIO = 5
# Rows of one address in one task of the join: all rows divided by this, at most.
FAIR_SHARES = 1000


def status_value(status: Column) -> Column:
    return F.when(status == "SUCCESS", 1.0).when(status == "FAIL", 0.0).otherwise(0.5)


def action_entropy(action: Column) -> Column:
    return batch_entropy(F.coalesce(action, F.lit("None")))


def per_source(df: DataFrame, **also: Column) -> DataFrame:
    """One row per address: hash, share of failures, distinct users and URLs, and what ``also`` sums.

    The share is 0 for an address with fewer than five rows.
    """
    failed = F.avg(F.when(F.col("status") == "FAIL", 1.0).otherwise(0.0))
    enough = F.count(F.lit(1)) >= MIN_ROWS_FOR_RATIO

    def distinct(column: str) -> Column:
        return F.count_distinct(column) if column in df.columns else F.lit(0).cast("bigint")

    counts = df.groupBy(SOURCE).agg(
        F.when(enough, failed).otherwise(F.lit(0.0)).alias("fail_ratio_per_ip"),
        distinct("usuario").alias("unique_users_per_ip"),
        distinct("url").alias("unique_urls_per_ip"),
        *[a.alias(name) for name, a in also.items()],
    )
    return counts.withColumn("ip_encoded", adler32(F.col(SOURCE)))


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` joined with the row of their address in ``sources``, which counts ``_rows``.

    An address with more than a fair share of all rows is dealt to as many tasks as its
    rows are shares: they are fewer than ``FAIR_SHARES``, so they are broadcast, and
    their row of ``sources`` is copied to each part. All others are joined by address.
    ``sources`` should be a stored table.
    """
    total = sources.agg(F.sum("_rows")).first()[0] or 0
    share = max(1, -(-total // FAIR_SHARES))
    parts = F.ceil(F.col("_rows") / share).cast("int")
    hot = sources.where(F.col("_rows") > share).select(SOURCE, parts.alias("_parts"))
    part = F.pmod(F.xxhash64(*LINE_KEYS), F.coalesce("_parts", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), SOURCE, "left").withColumn("_part", part).drop("_parts")
    copied = sources.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copied.drop("_rows"), [SOURCE, "_part"]).drop("_part")


def requests_per_minute(df: DataFrame) -> DataFrame:
    """Add the position-counted rows per address in (t - 1 min, t]."""
    return trailing_counts(df, 60, "requests_per_minute")


def extract_features(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Line keys and the eight features of every event that has address and time.

    The columns ``keep`` of the events are passed through behind them.
    """
    df = with_line_keys(events)
    entropy = action_entropy(F.col("accion")) if "accion" in df.columns else F.lit(0.0)
    others = [c for c in keep if c not in LINE_KEYS and c not in FEATURES]
    rows = df.select(
        *LINE_KEYS,
        SOURCE,
        "datetime",
        F.hour("datetime").alias("hour"),
        status_value(F.col("status")).alias("status_val"),
        entropy.alias("url_entropy"),
        # One by one, so that those nobody asks for are not shuffled.
        *[F.col(c).alias(f"_kept_{c}") for c in others],
    )
    sources = materialize(per_source(df, _rows=F.count(F.lit(1))))
    # Counting first: the window's small groups must not inherit a partitioning by address.
    return with_source(requests_per_minute(rows), sources).select(
        *LINE_KEYS, *FEATURES, *[F.col(f"_kept_{c}").alias(c) for c in others]
    )
