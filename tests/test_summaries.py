import csv
import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from duskwatch.operators.export import (
    alert_records,
    export_csv,
    export_json,
    export_json_document,
    export_report,
    flatten_records,
    json_document,
    long_records,
    report_info,
    report_name,
)
from duskwatch.operators.summaries import (
    forensic_view,
    hourly_intensity,
    threat_level,
    top_actors,
    totals,
)

from .helpers import frame

BASE = datetime(2026, 10, 11, 10, 15, 0)


def alert_rows(spark, rows):
    base = {"usuario": "u", "accion": "x", "status": "FAIL", "reason": "r", "rule": "Rule",
            "severity": "high", "timestamp": "t"}
    data = [{**base, **r} for r in rows]
    columns = ["datetime", "ip_origen", *base]
    schema = "datetime timestamp_ntz, " + ", ".join(f"{c} string" for c in columns[1:])
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in data], schema)


@pytest.mark.parametrize(
    "logs,found,level",
    [(0, 0, "LOW"), (0, 60, "LOW"), (1000, 0, "LOW"), (1000, 5, "LOW"), (1000, 6, "ELEVATED"),
     (100, 2, "ELEVATED"), (100, 6, "HIGH"), (100000, 51, "HIGH"), (100000, 50, "ELEVATED")],
)
def test_threat_level(spark, logs, found, level):
    counts = spark.createDataFrame([(logs, found)], "total_logs bigint, total_anomalies bigint")
    assert threat_level(counts).first().threat_level == level


def test_totals_of_empty_tables(spark):
    empty = spark.createDataFrame([], "a int")
    assert tuple(totals(empty, empty).first()) == (0, 0)


def test_top_actors_skips_blanks_after_the_cut(spark):
    ips = ["a"] * 3 + [" "] * 4 + ["b"] * 2 + ["c"] * 2 + ["d", "e", None, None, None]
    alerts = alert_rows(spark, [{"ip_origen": ip} for ip in ips])
    got = [tuple(r) for r in top_actors(alerts).orderBy(F.desc("hits"), "ip_origen").collect()]
    assert got == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]


def test_hours_without_events_are_zero(spark):
    rows = [{"datetime": BASE}, {"datetime": BASE + timedelta(minutes=1)}, {"datetime": BASE + timedelta(hours=3)}]
    got = hourly_intensity(frame(spark, rows)).orderBy("datetime").collect()
    assert [(r.datetime.hour, r.events) for r in got] == [(10, 2), (11, 0), (12, 0), (13, 1)]
    assert hourly_intensity(frame(spark, rows).limit(0)).count() == 0


def test_forensic_view(spark):
    rows = [
        {"datetime": BASE + timedelta(seconds=i), "ip_origen": "10.5.5.1", "status": "FAIL",
         "accion": "<b>" + "x" * 80, "usuario": "u"}
        for i in range(205)
    ]
    when = BASE + timedelta(seconds=204)
    alerts = alert_rows(
        spark,
        [
            {"datetime": when, "ip_origen": "10.5.5.1", "accion": "a", "rule": "First"},
            {"datetime": when, "ip_origen": "10.5.5.1", "accion": "b", "rule": "Second", "severity": "low"},
            {"datetime": BASE, "ip_origen": "10.5.5.1", "rule": "Too Old"},
        ],
    )
    got = forensic_view(frame(spark, rows), alerts).orderBy("line_no").collect()
    assert len(got) == 200 and got[0].line_no == 5
    assert (got[-1].label, got[-1].severity) == ("[SECOND]", "LOW")
    assert (got[0].label, got[0].severity) == ("", None)
    assert got[0].action_preview == "&lt;b&gt;" + "x" * 56 + "..."
    assert got[-1].time_text == "2026-10-11 10:18:24"


THREATS = [
    {"datetime": BASE, "ip_origen": "10.5.5.1", "reason": 'say "hi", bye'},
    {"datetime": BASE, "ip_origen": "10.5.5.2", "usuario": None},
]


def test_alert_records(spark):
    row = alert_records(alert_rows(spark, THREATS[1:])).first()
    record = json.loads(row.record)
    assert record["datetime"] == "2026-10-11 10:15:00" == row.datetime
    assert record["usuario"] is None


def test_json_report(spark, tmp_path):
    path = export_json(alert_records(alert_rows(spark, THREATS)), str(tmp_path), "rep", BASE)
    assert path == f"{tmp_path}/reports/rep.json"
    lines = [
        json.loads(line)
        for f in Path(path, "threats").glob("part-*")
        for line in f.read_text().splitlines()
    ]
    assert sorted(r["ip_origen"] for r in lines) == ["10.5.5.1", "10.5.5.2"]
    (meta,) = [f.read_text() for f in Path(path, "export_metadata").glob("part-*") if f.stat().st_size]
    assert json.loads(meta) == {"timestamp": BASE.isoformat(), "format": "json", "record_count": 2}


def nested(spark):
    return spark.createDataFrame(
        [("10.5.5.1", ("oak", 7), ["x", None], {"leaf": 3}, ([4, 5], {"k": "v"}))],
        "ip_origen string, tree struct<kind:string,rings:int>, marks array<string>, parts map<string,int>,"
        " deep struct<sizes:array<bigint>,notes:map<string,string>>",
    )


FLAT = {
    "deep_notes": '{"k":"v"}', "deep_sizes": "[4,5]", "ip_origen": "10.5.5.1", "marks": "x, None",
    "parts_leaf": "3", "tree_kind": "oak", "tree_rings": "7",
}


def test_flatten(spark):
    flat = flatten_records(nested(spark))
    assert flat.columns == list(FLAT)
    assert [str(v) for v in flat.first()] == list(FLAT.values())


def test_csv_report(spark, tmp_path):
    path = export_csv(nested(spark).coalesce(1), str(tmp_path), "nested")
    (part,) = Path(path).glob("part-*")
    with part.open() as f:
        (row,) = csv.DictReader(f)
    assert row == FLAT
    quoted = export_csv(alert_rows(spark, THREATS[:1]).coalesce(1), str(tmp_path), "quoted")
    (part,) = Path(quoted).glob("part-*")
    with part.open() as f:
        assert next(csv.DictReader(f))["reason"] == 'say "hi", bye'


def test_json_document(spark):
    many = spark.range(12_345).select("id", F.concat(F.lit('"'), F.col("id")).alias("quoted")).repartition(5)
    for records, count in ((nested(spark), 1), (many, 12_345), (many.limit(0), 0)):
        parts = json_document(records, BASE).orderBy("part", "n").collect()
        doc = json.loads("".join(p.text for p in parts))
        assert doc["export_metadata"] == {"timestamp": BASE.isoformat(), "format": "json", "record_count": count}
        assert len(doc["threats"]) == count
    doc = json.loads("".join(p.text for p in json_document(nested(spark), BASE).orderBy("part", "n").collect()))
    assert doc["threats"][0]["tree"] == {"kind": "oak", "rings": 7}


def test_json_document_as_ordered_files(spark, tmp_path):
    many = spark.range(50_000).select("id", F.concat(F.lit('"é'), F.col("id")).alias("quoted")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = export_json_document(many, str(tmp_path), "whole", BASE)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(Path(path).glob("part-*"))
    doc = json.loads("".join(f.read_text() for f in files))
    assert path.endswith("reports/whole.json") and len([f for f in files if f.stat().st_size]) > 1
    assert doc["export_metadata"]["record_count"] == 50_000
    assert sorted(t["id"] for t in doc["threats"]) == list(range(50_000))
    with pytest.raises(ValueError, match="at least one record"):
        export_json_document(many.limit(0), str(tmp_path), "none")


def test_long_records(spark):
    got = {(r["key"], r["value"]) for r in long_records(nested(spark)).collect()}
    assert got == set(FLAT.items())
    rows = spark.createDataFrame([("a", {"x": 1, "y": None}), ("b", None), (None, {})], "name string, m map<string,int>")
    by_record = {}
    for r in long_records(rows).collect():
        by_record.setdefault(r["record"], set()).add((r["key"], r["value"]))
    assert sorted(map(sorted, by_record.values()), key=str) == sorted(
        [[("m_x", "1"), ("m_y", None), ("name", "a")], [("name", "b")], [("name", None)]], key=str
    )


def test_a_map_with_a_million_keys(spark):
    wide = spark.range(10_000).selectExpr(
        "map_from_entries(transform(sequence(0, 99), k -> struct(concat('k', id * 100 + k) AS key, k AS value))) AS m"
    )
    long = long_records(wide)
    assert long.select("key").distinct().count() == 1_000_000
    with pytest.raises(ValueError, match="long_records"):
        flatten_records(wide)


def test_report_arguments(spark, tmp_path):
    with pytest.raises(ValueError, match="at least one record"):
        export_report(nested(spark).limit(0), "json", str(tmp_path))
    with pytest.raises(ValueError, match="one of"):
        export_report(nested(spark), "xml", str(tmp_path))
    path = export_report(nested(spark), "CSV", str(tmp_path), "../../outside")
    assert path == f"{tmp_path}/reports/outside.csv"
    with pytest.raises(ValueError):
        export_report(nested(spark), "csv", str(tmp_path), "..")


def test_report_names():
    parts = report_name("json", None, BASE).removesuffix(".json").split("_")
    assert parts[0] == "report" and [len(p) for p in parts[1:]] == [8, 6, 8]


def test_report_info(spark, tmp_path):
    path = export_json(nested(spark), str(tmp_path), "info_test")
    info = report_info(spark, path)
    assert (info["filename"], info["format"], info["path"]) == ("info_test.json", "json", path)
    assert info["size_bytes"] > 0 and info["created"]
    with pytest.raises(FileNotFoundError):
        report_info(spark, str(tmp_path / "missing.json"))
