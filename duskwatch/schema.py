"""The fixed event schema and the keys that give every line a stable order."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.scratch import materialize

# Canonical event columns, in output order, with their Spark types.
EVENT_TYPES = {
    "timestamp": "string",
    "datetime": "timestamp_ntz",
    "hostname": "string",
    "process": "string",
    "pid": "string",
    "ip_origen": "string",
    "usuario": "string",
    "accion": "string",
    "status": "string",
    "method": "string",
    "url": "string",
    "http_status": "string",
    "user_agent": "string",
    "referer": "string",
    "attack_types": "array<string>",
    "bytes_sent": "string",
    "log_level": "string",
}

EVENT_COLUMNS = list(EVENT_TYPES)

# What a web log states besides the fields of the time stamp: kept if asked for.
SOURCE_TYPES = {"source_year": "int", "source_offset": "string"}

# Where a line came from. (file_path, block, line_no) sorts in line order inside a
# file whatever the number of splits, and is the tie-break of every time window.
LINE_KEYS = ["file_path", "block", "line_no"]

# Lines of one file block are grouped in runs of 2^16 where a group must stay small.
RUN_BITS = 16


def line_key() -> Column:
    return F.struct(*[F.col(c) for c in LINE_KEYS])


def with_line_keys(df: DataFrame) -> DataFrame:
    """Add the line keys to an event table that did not come from a file.

    Such a table is written once: numbers made anew on each side of a join could differ.
    """
    if all(c in df.columns for c in LINE_KEYS):
        return df
    defaults = {
        "file_path": F.lit(""),
        "block": F.lit(0).cast("bigint"),
        "line_no": F.monotonically_increasing_id(),
    }
    return materialize(df.withColumns({c: e for c, e in defaults.items() if c not in df.columns}))


def project_events(df: DataFrame, also: Sequence[str] = (), keep_source_year: bool = False) -> DataFrame:
    """Line keys plus the canonical columns; columns a parser lacks become null.

    With ``keep_source_year`` the stated year and offset stand behind them.
    """
    types = {**EVENT_TYPES, **(SOURCE_TYPES if keep_source_year else {})}
    return df.select(
        *LINE_KEYS,
        *also,
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
            for c, t in types.items()
        ],
    )
