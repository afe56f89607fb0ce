"""Plain-text log files: reading lines, telling formats apart, making events."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duskwatch.functions.regex import strip
from duskwatch.functions.timestamps import infer_datetime, usual_layout
from duskwatch.schema import EVENT_COLUMNS, LINE_KEYS, SOURCE_TYPES, project_events
from duskwatch.scratch import materialize

from .formats import FORMATS, LineShape, LogFormat, columns_of

SAMPLE_LINES = 20
_MISSING = "PATH_NOT_FOUND"


def existing_paths(spark: SparkSession, paths: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """(paths that can be read, paths that do not exist)."""
    wanted = [paths] if isinstance(paths, str) else list(paths)

    def exist(some: list[str]) -> bool:
        try:
            spark.read.text(some)
        except AnalysisException as e:
            if e.getCondition() != _MISSING:
                raise
            return False
        return True

    if not wanted or exist(wanted):
        return wanted, []
    found = [p for p in wanted if exist([p])]
    return found, [p for p in wanted if p not in found]


def raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Every line of the files, with its place; bad UTF-8 becomes U+FFFD.

    Of several paths those that exist are read and the others named in the log
    (:func:`existing_paths` tells them). If none exists, that is an error.
    """
    found, missing = existing_paths(spark, paths)
    if missing:
        if not found:
            raise FileNotFoundError(f"None of these paths exists: {missing}")
        logging.getLogger(__name__).warning("No such paths: %s", missing)
    return spark.read.text(found).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_no"),
        F.make_valid_utf8("value").alias("value"),
    )


def log_lines(raw: DataFrame) -> DataFrame:
    """Stripped lines, blank ones left out."""
    # The same barrier as in LogFormat.parse: strip once, then filter.
    return raw.select(*LINE_KEYS, F.explode(F.array(strip(F.col("value")))).alias("value")).where(
        F.col("value") != ""
    )


def _votes(sample: DataFrame, number: Column, formats: Sequence[LogFormat]) -> DataFrame:
    """(file_path, format): the format with most of the first lines of each file."""
    first = Window.partitionBy("file_path").orderBy("block", "line_no")
    # Spark keeps the first few lines of a file in every task before it shuffles them.
    counted = sample.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE_LINES)
    votes = counted.withColumn("_fmt", number).groupBy("file_path").agg(
        *[F.count_if(F.col("_fmt") == i).alias(f"_v{i}") for i in range(len(formats))]
    )
    best = F.greatest(*[F.col(f"_v{i}") for i in range(len(formats))]) if len(formats) > 1 else F.col("_v0")
    pick = F
    for i, fmt in enumerate(formats):
        pick = pick.when(F.col(f"_v{i}") == best, F.lit(fmt.name))
    return votes.select("file_path", pick.alias("format"))


def detect_formats(raw: DataFrame, formats: Sequence[LogFormat] = FORMATS) -> DataFrame:
    """(file_path, format): the format most of a file's first lines match.

    Counts only the first ``SAMPLE_LINES`` raw lines of each file, however the file is
    split. The first format wins a tie. A line counts for the first format that knows it.
    """
    stripped = raw.withColumn("value", strip(F.col("value")))
    known = F
    for i, fmt in enumerate(formats):
        known = known.when((F.col("value") != "") & fmt.matches(F.col("value")), F.lit(i))
    return _votes(stripped, known, formats)


def _with_format(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """Add ``format`` by file; a file that ``formats`` does not name is an error."""
    named = formats.select("file_path", "format").where(F.col("format").isNotNull())
    missing = F.concat(F.lit("No format is given for "), F.col("file_path"))
    return lines.join(named, "file_path", "left").withColumn(
        "format", F.coalesce("format", F.raise_error(missing).cast("string"))
    )


def read_lines(raw: DataFrame, known: Sequence[LogFormat] = FORMATS, keep_source_year: bool = False) -> DataFrame:
    """Every raw line with what each format makes of it: the only pass over the text.

    A row per line and format that knows it, one with a null ``format`` for the others.
    ``first`` marks the row of the first such format, ``blank`` an empty line. The rest
    are the canonical columns, ``datetime`` still null, and with ``keep_source_year`` what
    web logs state beside them. Store it: votes, statistics and events are taken from its
    narrow columns.
    """
    shapes: list[LineShape] = []
    captured, owners = [], []
    value = F.col("value")
    for fmt in known:
        captured.append(F.split(fmt.captures(value, first=len(shapes)), "\n"))
        owners += [fmt.name] * len(fmt.shapes)
        shapes += fmt.shapes
    stripped = raw.select(*LINE_KEYS, F.explode(F.array(strip(F.col("value")))).alias("value"))
    got = stripped.select(
        *LINE_KEYS, (value == "").alias("blank"), F.explode(F.array(F.array(*captured))).alias("_all")
    )
    hits = F.filter("_all", lambda g: F.size(g) > 1)
    placed = got.select(*LINE_KEYS, "blank", F.posexplode_outer(hits).alias("_place", "_got"))
    made = [shape.columns(lambda n: F.col("_got")[n + 1]) for shape in shapes]
    number = F.col("_got")[1]

    def pick(of) -> Column:
        out = F
        for i in range(len(shapes)):
            if of(i) is not None:
                out = out.when(number == str(i), of(i))
        return out

    columns = {
        name: pick(lambda i, name=name: made[i].get(name)) for name in dict.fromkeys(c for m in made for c in m)
    }
    parsed = placed.select(
        *LINE_KEYS, "blank", (F.coalesce("_place", F.lit(0)) == 0).alias("first"),
        pick(lambda i: F.lit(owners[i])).alias("format"), *[c.alias(n) for n, c in columns.items()],
    )
    flags = ["blank", "first", "format"]
    return project_events(parsed, flags, keep_source_year)


def formats_of(read: DataFrame, known: Sequence[LogFormat] = FORMATS) -> DataFrame:
    """:func:`detect_formats` from stored :func:`read_lines`."""
    number = F
    for i, fmt in enumerate(known):
        number = number.when(F.col("format") == fmt.name, F.lit(i))
    return _votes(read.where("first").select("file_path", "block", "line_no", "format"), number, known)


def stats_of(read: DataFrame, formats: DataFrame | str) -> DataFrame:
    """:func:`parse_stats` from stored :func:`read_lines`."""
    mine = F.lit(formats) if isinstance(formats, str) else F.col("_format")
    rows = read if isinstance(formats, str) else _with_format(
        read.withColumnRenamed("format", "_own"), formats
    ).withColumnsRenamed({"format": "_format", "_own": "format"})
    return with_rate(
        rows.where(~F.col("blank")).groupBy("file_path").agg(
            F.count_if("first").alias("lines_read"), F.count_if(F.col("format") == mine).alias("lines_parsed")
        )
    )


def events_of(read: DataFrame, formats: DataFrame | str) -> DataFrame:
    """The rows of stored :func:`read_lines` that are in the format of their file."""
    columns = [*LINE_KEYS, *EVENT_COLUMNS, *[c for c in SOURCE_TYPES if c in read.columns]]
    if isinstance(formats, str):
        return read.where(F.col("format") == formats).select(columns)
    named = _with_format(read.withColumnRenamed("format", "_own"), formats)
    return named.where(F.col("_own") == F.col("format")).select(columns)


def parse_lines(
    lines: DataFrame,
    formats: DataFrame | str,
    known: Sequence[LogFormat] = FORMATS,
    keep_source_year: bool = False,
) -> DataFrame:
    """Lines to canonical columns (``datetime`` still null).

    ``formats`` names one format for all lines, or is a (file_path, format) table:
    lines of a file are read only by the format of that file.
    """
    by_name = {f.name: f for f in known}
    if isinstance(formats, str):
        return project_events(by_name[formats].parse(lines), keep_source_year=keep_source_year)
    shapes: list[LineShape] = []
    captured = F
    for fmt in known:
        mine = fmt.captures(F.col("value"), first=len(shapes))
        captured = captured.when(F.col("format") == fmt.name, mine)
        shapes += fmt.shapes
    placed = _with_format(lines, formats)
    return project_events(columns_of(placed, "value", captured, shapes), keep_source_year=keep_source_year)


def cast_times(parsed: DataFrame, now: datetime) -> DataFrame:
    """Fill ``datetime`` and drop the rows that have none.

    Stamps are dated by ``now``, or by the column ``source_year`` if there is one and it
    states a year. The offset is no part of ``datetime``, which is the time as written.
    """
    stamped = parsed.withColumn("_stamp", usual_layout(F.col("timestamp")))
    others = [c for c in parsed.columns if c != "datetime"]
    # As in columns_of: the filter must not repeat the expression.
    stated = F.col("source_year") if "source_year" in parsed.columns else None
    moment = infer_datetime(F.col("_stamp"), now, stated)
    timed = stamped.select(*others, F.explode(F.array(moment)).alias("datetime"))
    return timed.where(F.col("datetime").isNotNull()).select(*parsed.columns)


def read_events(
    spark: SparkSession,
    paths: str | Sequence[str],
    now: datetime,
    formats: DataFrame | str | None = None,
    known: Sequence[LogFormat] = FORMATS,
    keep_source_year: bool = False,
) -> DataFrame:
    """Files to the canonical event table.

    The text is read once. Without ``formats`` what every format makes of each line is
    stored first, and the votes and the events are taken from there; naming the format
    saves that table. ``keep_source_year`` dates web logs by the year they state and adds
    the columns ``source_year`` and ``source_offset``.
    """
    raw = raw_lines(spark, paths)
    if formats is not None:
        return cast_times(parse_lines(log_lines(raw), formats, known, keep_source_year), now)
    read = materialize(read_lines(raw, known, keep_source_year))
    return cast_times(events_of(read, materialize(formats_of(read, known))), now)


def parse_stats(
    lines: DataFrame,
    formats: DataFrame | str,
    known: Sequence[LogFormat] = FORMATS,
) -> DataFrame:
    """Lines read, parsed and discarded per file, before times are checked."""

    def parsed(fmt: LogFormat) -> Column:
        return fmt.matches(F.col("value"))

    if isinstance(formats, str):
        hit = parsed({f.name: f for f in known}[formats])
    else:
        lines = _with_format(lines, formats)
        hit = F.lit(False)
        for fmt in known:
            hit = hit | ((F.col("format") == fmt.name) & parsed(fmt))
    return with_rate(
        lines.groupBy("file_path").agg(
            F.count(F.lit(1)).alias("lines_read"), F.count_if(hit).alias("lines_parsed")
        )
    )


def with_rate(counts: DataFrame) -> DataFrame:
    read, parsed = F.col("lines_read"), F.col("lines_parsed")
    return counts.withColumns(
        {
            "lines_discarded": read - parsed,
            "parse_rate": F.when(read > 0, parsed / read * 100).otherwise(F.lit(0.0)),
        }
    )


def stats_report(stats: DataFrame, events: DataFrame) -> DataFrame:
    """Statistics for display, with the fields found in files that gave events."""
    filled = events.groupBy("file_path").agg(F.count(F.lit(1)).alias("_events"))
    return stats.join(filled, "file_path", "left").select(
        "file_path",
        "lines_read",
        "lines_parsed",
        F.bround("parse_rate", 2).alias("parse_rate_percent"),
        F.when(F.col("_events") > 0, F.array(*[F.lit(c) for c in EVENT_COLUMNS]))
        .otherwise(F.array().cast("array<string>"))
        .alias("extracted_fields"),
    )
