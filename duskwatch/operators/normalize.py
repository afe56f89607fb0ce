"""Normalising the event table before the rules see it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import url_decode

NO_USER = "-"
NO_IP = "0.0.0.0"


def normalize(events: DataFrame) -> DataFrame:
    """Decode URLs into ``url_decoded`` and fill missing users and addresses."""
    decoded = url_decode(F.col("url")) if "url" in events.columns else F.lit("")
    # Three rules read the decoded text; behind explode() it is computed once.
    out = events.select("*", F.explode(F.array(decoded)).alias("url_decoded"))
    fills = {"usuario": NO_USER, "ip_origen": NO_IP}
    return out.withColumns(
        {c: F.coalesce(c, F.lit(v)) for c, v in fills.items() if c in out.columns}
    )
