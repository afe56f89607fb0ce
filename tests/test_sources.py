from datetime import datetime

import pytest
from pyspark.sql import functions as F

from duskwatch.functions.timestamps import normalize_timestamp
from duskwatch.schema import EVENT_COLUMNS, LINE_KEYS
from duskwatch.scratch import materialize
from duskwatch.sources import text_logs
from duskwatch.sources.formats import LineShape, LogFormat
from duskwatch.sources.text_logs import (
    cast_times,
    detect_formats,
    events_of,
    existing_paths,
    formats_of,
    log_lines,
    parse_lines,
    raw_lines,
    read_events,
    read_lines,
    stats_of,
    stats_report,
)

from .helpers import NOW, frame, write_log

FAILED = "Oct 11 10:00:00 birch sshd[871]: Failed password for olga from 10.20.30.40"
ACCESS = '10.20.30.41 - - [11/Oct/2026:10:00:00 +0000] "GET {} HTTP/1.1" {} 77 "-" "Lynx/2.9"'
ERROR = (
    "[Sun Oct 11 10:00:00.000321 2026] [warn] [pid 42] [client 10.20.30.42:1025] No such shelf"
)


def parsed(spark, tmp_path, text, name="a.log"):
    return read_events(spark, write_log(tmp_path, name, text), NOW).orderBy("line_no").collect()


def test_failed_login(spark, tmp_path):
    (row,) = parsed(spark, tmp_path, FAILED)
    assert (row.status, row.usuario, row.ip_origen) == ("FAIL", "olga", "10.20.30.40")
    assert (row.hostname, row.process, row.pid) == ("birch", "sshd", "871")
    assert row.datetime == datetime(2026, 10, 11, 10, 0, 0)


def test_accepted_login_and_session(spark, tmp_path):
    rows = parsed(
        spark,
        tmp_path,
        "Oct 11 12:00:00 birch sshd[19]: Accepted password for yusuf from 10.20.30.43\n"
        "Oct  1 10:00:00 birch sshd[20]: session opened for user mei\n"
        "Oct 11 10:00:00 birch sshd: session closed for user mei\n",
    )
    assert [(r.status, r.usuario, r.ip_origen, r.pid) for r in rows] == [
        ("SUCCESS", "yusuf", "10.20.30.43", "19"),
        ("SUCCESS", "mei", None, "20"),
        ("FAIL", "mei", None, None),
    ]
    assert rows[1].datetime == datetime(2026, 10, 1, 10, 0, 0)


def test_access_line(spark, tmp_path):
    (row,) = parsed(spark, tmp_path, ACCESS.format("/tea/green", 200))
    assert (row.ip_origen, row.method, row.url) == ("10.20.30.41", "GET", "/tea/green")
    assert (row.http_status, row.status, row.user_agent) == ("200", "SUCCESS", "Lynx/2.9")
    assert (row.accion, row.hostname, row.process) == ("GET /tea/green", "-", "web_server")
    assert (row.usuario, row.attack_types, row.bytes_sent) == (None, None, "77")
    assert row.timestamp == "Oct 11 10:00:00"


def test_error_line(spark, tmp_path):
    (row,) = parsed(spark, tmp_path, ERROR)
    assert (row.ip_origen, row.status, row.log_level) == ("10.20.30.42", "FAIL", "warn")
    assert (row.pid, row.accion, row.url) == ("42", "No such shelf", None)


def test_http_status_classes(spark, tmp_path):
    text = "\n".join(ACCESS.format("/x", code) for code in (200, 301, 404, 500, 101))
    assert [r.status for r in parsed(spark, tmp_path, text)] == [
        "SUCCESS",
        "SUCCESS",
        "FAIL",
        "FAIL",
        "INFO",
    ]


def test_parse_time_tags(spark, tmp_path):
    urls = ["/a;b", "/a", "/a%0Ab", "/a?x=$(id)", "/a'b"]
    rows = parsed(spark, tmp_path, "\n".join(ACCESS.format(u, 200) for u in urls))
    tag = ["command_injection"]
    assert [r.attack_types for r in rows] == [tag, None, tag, tag, None]


def test_bad_times_are_dropped(spark, tmp_path):
    rows = parsed(
        spark,
        tmp_path,
        "yesterday birch sshd[871]: Failed password for olga from 10.20.30.40\n"
        "Feb 29 10:00:00 birch sshd[1]: Failed password for olga from 10.20.30.40\n"
        "Oct 32 10:00:00 birch sshd[1]: Failed password for olga from 10.20.30.40\n"
        "Oct 11 25:00:00 birch sshd[1]: Failed password for olga from 10.20.30.40\n" + FAILED,
    )
    assert len(rows) == 1


def test_garbage_and_empty_files(spark, tmp_path):
    garbage = "Dear diary,\nit rained until noon.\n"
    assert parsed(spark, tmp_path, garbage) == []
    path = write_log(tmp_path, "empty.log", "")
    assert read_events(spark, path, NOW).columns == [*LINE_KEYS, *EVENT_COLUMNS]
    assert read_events(spark, path, NOW).count() == 0


def test_missing_paths(spark, tmp_path):
    good, gone = write_log(tmp_path, "good.log", FAILED + "\n" + FAILED), str(tmp_path / "gone.log")
    assert raw_lines(spark, [gone, good, gone]).count() == 2
    assert existing_paths(spark, [gone, good]) == ([good], [gone])
    with pytest.raises(FileNotFoundError, match="gone.log"):
        raw_lines(spark, [gone])


@pytest.mark.parametrize("split", ["400", "8192", "134217728"])
def test_detection_does_not_depend_on_splits(spark, tmp_path, split):
    text = "\n".join([FAILED] * 5 + [ACCESS.format("/long/" + "x" * 50, 200)] * 15 + [FAILED] * 50)
    path = write_log(tmp_path, "mixed.log", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert detect_formats(raw_lines(spark, path)).first().format == "web"
        assert read_events(spark, path, NOW).count() == 15
        read = materialize(read_lines(raw_lines(spark, path)))
        assert formats_of(read).first().format == "web"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_file_without_a_format_is_an_error(spark, tmp_path):
    write_log(tmp_path, "a.log", FAILED)
    write_log(tmp_path, "b.log", FAILED)
    raw = raw_lines(spark, str(tmp_path))
    some = formats_of(materialize(read_lines(raw))).where("file_path like '%a.log'")
    for use in (lambda: parse_lines(log_lines(raw), some), lambda: stats_of(read_lines(raw), some)):
        with pytest.raises(Exception, match="No format is given for .*b.log"):
            use().collect()


def test_blank_lines_padding_and_bad_bytes(spark, tmp_path):
    text = b"\n  \t\n \x1c " + FAILED.encode() + b" \xa0\xff \r\n\x0b\n"
    path = write_log(tmp_path, "b.log", text)
    (line,) = log_lines(raw_lines(spark, path)).collect()
    assert line.value.startswith("Oct 11")
    assert line.value.endswith("��")
    assert len(parsed(spark, tmp_path, text)) == 1


@pytest.mark.parametrize(
    "text,name",
    [
        (FAILED, "syslog"),
        (ACCESS.format("/", 200), "web"),
        (ERROR, "web"),
        (FAILED + "\n" + ERROR, "syslog"),
        ("nothing", "syslog"),
        ("\n" * 20 + ERROR, "syslog"),
        ("x\n" * 19 + ERROR, "web"),
    ],
)
def test_format_detection(spark, tmp_path, text, name):
    path = write_log(tmp_path, "d.log", text + "\n")
    (row,) = detect_formats(raw_lines(spark, path)).collect()
    assert row.format == name


def test_a_folder_may_mix_formats(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    write_log(folder, "auth.log", FAILED + "\n" + ACCESS.format("/ignored", 200))
    write_log(folder, "web.log", "\n".join([ERROR, ACCESS.format("/kept", 200), FAILED, ERROR]))
    rows = read_events(spark, str(folder), NOW).collect()
    got = sorted((r.file_path.rsplit("/", 1)[1], r.accion) for r in rows)
    assert got == [
        ("auth.log", "Failed password for olga from 10.20.30.40"),
        ("web.log", "GET /kept"),
        ("web.log", "No such shelf"),
        ("web.log", "No such shelf"),
    ]


def test_line_keys_keep_the_order_over_many_splits(spark, tmp_path):
    count = 3000
    text = "\n".join(f"Oct 11 10:00:00 h p: number {i}" for i in range(count))
    path = write_log(tmp_path, "big.log", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        raw = raw_lines(spark, path)
        assert raw.select("block").distinct().count() > 5
        rows = log_lines(raw).orderBy(*LINE_KEYS).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [int(r.value.rsplit(" ", 1)[1]) for r in rows] == list(range(count))


@pytest.mark.parametrize(
    "raw,want",
    [
        ("11/Oct/2026:10:00:00 +0000", "Oct 11 10:00:00"),
        ("11/oct/2026:10:00:00 -0730", "Oct 11 10:00:00"),
        ("1/Oct/2026:1:02:03", "Oct 01 01:02:03"),
        ("Sun Oct 11 10:00:00.5 2026", "Oct 11 10:00:00"),
        ("Mon Oct  1 10:00:00 2026", "Oct 01 10:00:00"),
        ("Oct 31 23:59:59 2026", "Oct 31 23:59:59"),
        ("[29/Feb/2024:10:00:00 +0000", "Feb 29 10:00:00"),
        ("29/Feb/2023:10:00:00 +0000", "29/Feb/2023:10:00:00"),
        ("Oct 11 10:00:00.5 2026", "Oct 11 10:00:00.5 20"),
        ("31/Apr/2026:10:00:00 +0000", "31/Apr/2026:10:00:00"),
        ("11/Oct/2026:24:00:00 +0000", "11/Oct/2026:24:00:00"),
        ("11/Oct/2026:10:00:00 UTC", "11/Oct/2026:10:00:00"),
        ("2026/10/11 10:00:00", "2026/10/11 10:00:00"),
    ],
)
def test_time_stamp_layouts(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(normalize_timestamp(F.col("raw"))).first()[0] == want


@pytest.mark.parametrize(
    "stamp,now,want",
    [
        ("Oct 11 10:00:00", datetime(2026, 12, 1), datetime(2026, 10, 11, 10)),
        ("Dec 31 10:00:00", datetime(2026, 12, 1), datetime(2025, 12, 31, 10)),
        ("Jan 15 00:00:00", datetime(2024, 1, 15), datetime(2024, 1, 15)),
        ("Jan 15 00:00:01", datetime(2024, 1, 15), datetime(2023, 1, 15, 0, 0, 1)),
        ("Feb 29 00:00:00", datetime(2024, 6, 1), None),
        ("feb  3 1:02:03", datetime(2024, 6, 1), datetime(2024, 2, 3, 1, 2, 3)),
        ("Feb 003 10:00:00", datetime(2024, 6, 1), None),
        ("Oct 11 10:00:60", datetime(2026, 12, 1), None),
    ],
)
def test_year_inference(spark, stamp, now, want):
    df = spark.createDataFrame([(stamp, None)], "timestamp string, datetime timestamp_ntz")
    rows = cast_times(df, now).collect()
    assert [r.datetime for r in rows] == ([] if want is None else [want])


def test_statistics(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    bad_time = FAILED.replace("Oct 11", "Oct 32")
    write_log(folder, "a.log", "\n".join([FAILED, "garbage", "", bad_time, FAILED]))
    write_log(folder, "b.log", "prose\nmore prose\n")
    read = materialize(read_lines(raw_lines(spark, str(folder))))
    formats = materialize(formats_of(read))
    stats = stats_of(read, formats)
    got = {r.file_path.rsplit("/", 1)[1]: r for r in stats.collect()}
    a, b = got["a.log"], got["b.log"]
    assert (a.lines_read, a.lines_parsed, a.lines_discarded, a.parse_rate) == (4, 3, 1, 75.0)
    assert (b.lines_read, b.lines_parsed, b.lines_discarded, b.parse_rate) == (2, 0, 2, 0.0)
    events = cast_times(events_of(read, formats), NOW)
    report = {r.file_path.rsplit("/", 1)[1]: r for r in stats_report(stats, events).collect()}
    assert report["a.log"].parse_rate_percent == 75.0
    assert report["a.log"].extracted_fields == EVENT_COLUMNS
    assert report["b.log"].extracted_fields == []


def test_own_format(spark, tmp_path):
    own = LogFormat(
        "pipe",
        (
            LineShape(
                r"^(\w{3} \d\d \S+)\|(\S+)\|(.*)$",
                3,
                lambda g: {
                    "timestamp": g(1),
                    "ip_origen": g(2),
                    "accion": g(3),
                    "status": F.lit("INFO"),
                },
            ),
        ),
    )
    path = write_log(tmp_path, "p.log", "Oct 11 10:00:00|10.20.30.49|did it\nno\n")
    (row,) = read_events(spark, path, NOW, formats="pipe", known=[own]).collect()
    assert (row.ip_origen, row.accion, row.datetime.hour) == ("10.20.30.49", "did it", 10)


def test_overlapping_formats_are_read_by_the_one_of_the_file(spark, tmp_path):
    def own(name, pattern):
        columns = lambda g: {"timestamp": g(1), "accion": g(2), "status": F.lit(name)}
        return LogFormat(name, (LineShape(pattern, 2, columns),))

    known = [own("narrow", r"^(\w{3} \d\d \S+) (a\S*)$"), own("wide", r"^(\w{3} \d\d \S+) (.*)$")]
    text = "\n".join(["Oct 11 10:00:00 abc"] + ["Oct 11 10:00:00 some words"] * 3)
    path = write_log(tmp_path, "o.log", text)
    read = materialize(read_lines(raw_lines(spark, path), known))
    formats = materialize(formats_of(read, known))
    assert formats.first().format == "wide"
    assert {r.status for r in events_of(read, formats).collect()} == {"wide"}
    assert events_of(read, formats).count() == 4
    assert [(r.lines_read, r.lines_parsed) for r in stats_of(read, formats).collect()] == [(4, 4)]
    assert events_of(read, "narrow").count() == 1


def test_regex_runs_once_per_line(spark, tmp_path):
    raw = raw_lines(spark, write_log(tmp_path, "r.log", FAILED))
    plan = parse_lines(log_lines(raw), "syslog")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(value") == 1


def test_the_stated_year_and_offset_can_be_kept(spark, tmp_path):
    lines = [
        '10.0.0.1 - - [29/Feb/2024:10:00:00 +0530] "GET / HTTP/1.1" 200 1 "-" "x"',
        '10.0.0.2 - - [1/mar/2019:9:00:00] "GET / HTTP/1.1" 200 1 "-" "x"',
        '10.0.0.3 - - [01/Mar/2031:09:00:00 Z] "GET / HTTP/1.1" 200 1 "-" "x"',
        "[Thu Feb 29 10:00:00.5 2024] [error] [client 10.0.0.4:1] gone",
        '10.0.0.5 - - [30/Feb/2024:10:00:00 +0000] "GET / HTTP/1.1" 200 1 "-" "x"',
    ]
    web = write_log(tmp_path, "web.log", "\n".join(lines))
    auth = write_log(tmp_path, "auth.log", "Oct 11 10:00:00 h sshd[1]: Failed password for root from 10.0.0.9\n")
    now = datetime(2026, 12, 1)
    for formats in (None, detect_formats(raw_lines(spark, [web, auth]))):
        events = read_events(spark, [web, auth], now, formats, keep_source_year=True)
        got = {r.ip_origen: (r.datetime, r.source_year, r.source_offset) for r in events.collect()}
        assert got == {
            "10.0.0.1": (datetime(2024, 2, 29, 10), 2024, "+0530"), "10.0.0.2": (datetime(2019, 3, 1, 9), 2019, None),
            "10.0.0.3": (datetime(2031, 3, 1, 9), 2031, "Z"), "10.0.0.4": (datetime(2024, 2, 29, 10), 2024, None),
            "10.0.0.9": (datetime(2026, 10, 11, 10), None, None),
        }
    plain = read_events(spark, [web, auth], now)
    assert "source_year" not in plain.columns
    assert {r.ip_origen: r.datetime.year for r in plain.collect()} == {"10.0.0.2": 2026, "10.0.0.3": 2026, "10.0.0.9": 2026}


def test_events_are_read_in_one_pass_over_the_text(spark, tmp_path, monkeypatch):
    path = write_log(tmp_path, "auth.log", "Oct 11 10:00:00 h sshd[1]: Failed password for root from 10.0.0.9\n")
    plans = []

    def keep(df, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, path)

    monkeypatch.setattr(text_logs, "materialize", keep)
    events = read_events(spark, path, datetime(2026, 12, 1))
    plans.append(events._jdf.queryExecution().executedPlan().toString())
    assert events.count() == 1 and sum(p.count("FileScan text") for p in plans) == 1
