"""Reports: alert records written as JSON or CSV under a ``reports`` folder.

A report is a folder of part files (every executor writes its own), named like the
single file it stands for. A report can also be had as the parts of one JSON document.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.scratch import materialize

FORMATS = ("json", "csv")
REPORTS = "reports"
# Columns that the keys of all maps may become.
MOST_KEYS = 10_000


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alerts with the time as text, and each row as a JSON record."""
    shown = alerts.withColumn("datetime", F.col("datetime").cast("string"))
    return shown.withColumn("record", to_record([F.col(c) for c in shown.columns]))


def to_record(columns: list[Column]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def flatten_records(records: DataFrame) -> DataFrame:
    """One level of nesting as columns ``parent_child``; lists as text; sorted names.

    A map's keys are looked up in the records first, in one pass for all maps, and
    become columns like the fields of a struct. What is nested deeper becomes JSON text.
    More than ``MOST_KEYS`` different keys are an error: no table has that many columns,
    and :func:`long_records` holds them as rows.
    """
    maps = [f.name for f in records.schema.fields if isinstance(f.dataType, T.MapType)]
    keys: dict[str, list] = {name: [] for name in maps}
    if maps:
        def met_in(name: str) -> Column:
            return F.transform(F.map_keys(f"`{name}`"), lambda k: F.struct(F.lit(name).alias("map"), k.cast("string").alias("key")))

        met = [met_in(m) for m in maps]
        all_met = F.flatten(F.array_compact(F.array(*met)))
        different = records.select(F.explode(all_met).alias("k")).distinct().select("k.*")
        for name, key in different.limit(MOST_KEYS + 1).collect():
            keys[name].append(key)
        if sum(map(len, keys.values())) > MOST_KEYS:
            raise ValueError(f"Maps with more than {MOST_KEYS} different keys: see long_records()")
    flat: dict[str, Column] = {}
    for field in records.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.StructType):
            for sub in kind.fields:
                flat[f"{field.name}_{sub.name}"] = _plain(column.getField(sub.name), sub.dataType)
        elif isinstance(kind, T.MapType):
            named = F.transform_keys(column, lambda k, _: k.cast("string"))
            for key in keys[field.name]:
                flat[f"{field.name}_{key}"] = _plain(F.try_element_at(named, F.lit(key)), kind.valueType)
        elif isinstance(kind, T.ArrayType):
            flat[field.name] = _joined(column, kind)
        else:
            flat[field.name] = column
    return records.select(*[flat[name].alias(name) for name in sorted(flat)])


def _plain(column: Column, kind: T.DataType) -> Column:
    nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
    return F.to_json(column, {"ignoreNullFields": "false"}) if nested else column


def _joined(column: Column, kind: T.ArrayType) -> Column:
    def as_text(value: Column) -> Column:
        return F.coalesce(_plain(value, kind.elementType).cast("string"), F.lit("None"))

    return F.array_join(F.transform(column, as_text), ", ")


def long_records(records: DataFrame) -> DataFrame:
    """(record, key, value): what :func:`flatten_records` has in columns, as rows of text.

    For maps with any number of different keys: nothing is looked up beforehand, and no
    row grows with them. ``record`` tells the rows of a record apart; a field that is null,
    and a null value in a map, is a row with a null value; a record always has all its
    fields, and of a map the keys it holds (a null or empty map none).
    """
    pairs = "array<struct<key:string,value:string>>"

    def pair(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.cast("string").alias("value"))

    parts = []
    for field in records.schema.fields:
        column, kind, name = F.col(f"`{field.name}`"), field.dataType, field.name
        if isinstance(kind, T.StructType):
            told = [pair(F.lit(f"{name}_{s.name}"), _plain(column.getField(s.name), s.dataType)) for s in kind.fields]
        elif isinstance(kind, T.ArrayType):
            told = [pair(F.lit(name), _joined(column, kind))]
        elif not isinstance(kind, T.MapType):
            told = [pair(F.lit(name), column)]
        else:
            entries = _entries(column, F.lit(f"{name}_"), kind)
            parts.append(F.coalesce(entries.cast(pairs), F.array().cast(pairs)))
            continue
        parts.append(F.array(*told).cast(pairs))
    numbered = records.select(F.monotonically_increasing_id().alias("record"), F.concat(*parts).alias("_pairs"))
    return numbered.select("record", F.inline("_pairs"))


def _entries(column: Column, prefix: Column, kind: T.MapType) -> Column:
    def told(entry: Column) -> Column:
        value = _plain(entry["value"], kind.valueType).cast("string")
        return F.struct(F.concat(prefix, entry["key"].cast("string")).alias("key"), value.alias("value"))

    return F.transform(F.map_entries(column), told)


def report_name(fmt: str, name: str | None, now: datetime) -> str:
    """``report_<date>_<time>_<id>.<fmt>``, or the base name the caller gave."""
    if name:
        base = PurePosixPath(name).name
        if base in ("", ".", ".."):
            raise ValueError(f"Not a file name: {name!r}")
        return f"{base}.{fmt}"
    return f"report_{now:%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}.{fmt}"


def _target(base_dir: str, fmt: str, name: str | None, now: datetime) -> str:
    return f"{base_dir.rstrip('/')}/{REPORTS}/{report_name(fmt, name, now)}"


def _counted(records: DataFrame) -> tuple[DataFrame, Observation]:
    """The records, and their number once they have been written."""
    seen = Observation()
    return records.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _require_rows(seen: Observation) -> int:
    if not seen.get["n"]:
        raise ValueError("A report needs at least one record")
    return seen.get["n"]


def export_json(
    records: DataFrame, base_dir: str, name: str | None = None, now: datetime | None = None
) -> str:
    """Write ``threats`` as JSON lines, and then one row of ``export_metadata``.

    Records are counted while they are written. Without any, the folder of ``threats``
    stays empty, no metadata is written, and that is an error.
    """
    now = now or datetime.now()
    path = _target(base_dir, "json", name, now)
    counted, seen = _counted(_shown(records))
    counted.write.mode("overwrite").json(f"{path}/threats", ignoreNullFields=False)
    meta = [(now.isoformat(), "json", _require_rows(seen))]
    records.sparkSession.createDataFrame(meta, "timestamp string, format string, record_count bigint").coalesce(
        1
    ).write.mode("overwrite").json(f"{path}/export_metadata")
    return path


def _shown(records: DataFrame) -> DataFrame:
    """Times as the text that alert records carry."""
    return records.withColumns(
        {f.name: F.col(f"`{f.name}`").cast("string") for f in records.schema if isinstance(f.dataType, T.TimestampNTZType)}
    )


def export_csv(
    records: DataFrame, base_dir: str, name: str | None = None, now: datetime | None = None
) -> str:
    """Write flattened records as CSV with a header; none at all are an error."""
    path = _target(base_dir, "csv", name, now or datetime.now())
    counted, seen = _counted(flatten_records(_shown(records)))
    counted.write.mode("overwrite").csv(
        path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    _require_rows(seen)
    return path


def export_report(
    records: DataFrame,
    fmt: str,
    base_dir: str,
    name: str | None = None,
    now: datetime | None = None,
) -> str:
    writers = {"json": export_json, "csv": export_csv}
    if fmt.lower() not in FORMATS:
        raise ValueError(f"Reports are written as one of {FORMATS}, not {fmt!r}")
    return writers[fmt.lower()](records, base_dir, name, now)


def json_document(records: DataFrame, now: datetime) -> DataFrame:
    """(part, n, text): one JSON document of any size, as texts to be put together in order.

    Part 0 is its head with the number of records, part 1 has a record in each row, part
    2 is its tail. Nothing is gathered: whoever writes the file streams the rows sorted.
    """
    rows = materialize(
        _shown(records).select(to_record([F.col(f"`{c}`") for c in records.columns]).alias("text")).withColumn(
            "n", F.monotonically_increasing_id()
        )
    )
    count, first = rows.agg(F.count(F.lit(1)), F.min("n")).first()
    comma = F.when(F.col("n") == F.lit(first), F.lit("")).otherwise(F.lit(", "))
    told = rows.select(F.lit(1).alias("part"), "n", F.concat(comma, "text").alias("text"))
    meta = json.dumps({"timestamp": now.isoformat(), "format": "json", "record_count": count})
    ends = [(0, 0, f'{{"export_metadata": {meta}, "threats": ['), (2, 0, "]}")]
    return told.unionByName(records.sparkSession.createDataFrame(ends, "part int, n bigint, text string"))


def export_json_document(records: DataFrame, base_dir: str, name: str | None = None, now: datetime | None = None) -> str:
    """Write one JSON document of any size as ordered text files; none at all are an error.

    The part files, one after the other in the order of their names, are the document
    ``{"export_metadata": ..., "threats": [...]}`` (as ``cat`` or a file store's own
    concatenation makes it), with a record on each line. The rows are dealt by ranges of
    their place, so every executor writes its own stretch and none has all.
    """
    now = now or datetime.now()
    path = _target(base_dir, "json", name, now)
    parts = materialize(json_document(records, now))
    if parts.where("part = 1").isEmpty():
        raise ValueError("A report needs at least one record")
    parts.orderBy("part", "n").select("text").write.mode("overwrite").text(path)
    return path


def report_info(spark: SparkSession, path: str) -> dict:
    """Name, size, time of writing and format of a report, from file listings only."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        size, created = (
            files.where(~F.col("path").rlike(r"/[._][^/]*$"))
            .agg(F.sum("length"), F.date_format(F.min("modificationTime"), "yyyy-MM-dd'T'HH:mm:ss"))
            .first()
        )
    except AnalysisException as e:
        raise FileNotFoundError(f"No report at {path}") from e
    return {
        "filename": PurePosixPath(path).name,
        "path": path,
        "size_bytes": size,
        "created": created,
        "format": PurePosixPath(path).suffix.lower().lstrip("."),
    }
