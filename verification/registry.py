"""The registered queries, and the DuckDB statement each is compared with."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.text import adler32, preview, url_decode
from duskwatch.functions.timestamps import infer_datetime, normalize_timestamp, usual_layout
from duskwatch.operators import iforest
from duskwatch.operators.detect import ALERT_KEYS, Detector
from duskwatch.operators.export import (
    alert_records,
    export_csv,
    export_json,
    flatten_records,
    json_document,
)
from duskwatch.operators.features import (
    FEATURES,
    action_entropy,
    extract_features,
    per_source,
    requests_per_minute,
    status_value,
)
from duskwatch.operators.normalize import normalize
from duskwatch.operators.rules import (
    RowRule,
    Rule,
    brute_force,
    path_traversal,
    sql_injection,
    time_anomaly,
    user_probing,
    web_attack,
    xss_attack,
)
from duskwatch.operators.summaries import (
    forensic_view,
    hourly_intensity,
    threat_level,
    top_actors,
    totals,
)
from duskwatch.schema import EVENT_COLUMNS, LINE_KEYS
from duskwatch.scratch import materialize, scratch_folder
from duskwatch.sources.formats import (
    attack_tags,
    auth_status,
    extract_ip,
    extract_user,
    http_status_class,
)
from duskwatch.sources.text_logs import (
    cast_times,
    detect_formats,
    events_of,
    formats_of,
    log_lines,
    parse_lines,
    raw_lines,
    read_lines,
    stats_of,
    stats_report,
)

from . import lines as L
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PACK = L.MEDIUM
WITH = S.ctes(PACK)
WITH_DENSE = S.ctes(L.DENSE)
KEYS = ", ".join(LINE_KEYS)
REPORT_KEYS = ", ".join(f'"{c}"' for c in ["datetime", *ALERT_KEYS[1:]])


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(texts: list[str], number: Column) -> Column:
    place = (F.pmod(number, F.lit(len(texts))) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(t) for t in texts]), place)


def pick_sql(texts: list[str], number: str) -> str:
    return f"{S._texts(texts)}[{number} % {len(texts)} + 1]"


# ------------------------------------------------------------ sources, parsing


@query(
    "log_lines",
    f"WITH l AS ({S.syslog_lines(PACK)}) SELECT value AS line FROM l WHERE line_no % 13 <> 0",
)
def q_log_lines(spark, sf_dir):
    """Written as text with blank lines and padding, read back by the text source."""
    path = scratch_folder(spark)
    lines = L.syslog_lines(spark, sf_dir, PACK)
    padded = F.when(F.col("line_no") % 13 == 0, "  \t ").when(
        F.col("line_no") % 5 == 0, F.concat(F.lit("  "), "value", F.lit("\t"))
    )
    lines.select(padded.otherwise(F.col("value")).alias("value")).write.text(path)
    return log_lines(raw_lines(spark, path)).select(F.col("value").alias("line"))


def _mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """23 files; the higher the file number, the more of its lines are web lines."""
    sys, web = (
        f(spark, sf_dir, PACK).select("line_no", F.col("value").alias(n))
        for f, n in ((L.syslog_lines, "s"), (L.access_lines, "w"))
    )
    number = F.col("user_id") % 23
    who = L.events(spark, sf_dir).select(F.col("event_id").alias("line_no"), number.alias("file"))
    web_line = F.col("line_no") % 23 < F.col("file")
    value = F.when(F.col("line_no") % 7 == 0, "").when(web_line, F.col("w")).otherwise(F.col("s"))
    return (
        who.join(sys, "line_no")
        .join(web, "line_no")
        .select(
            F.concat(F.lit("mix-"), F.col("file").cast("string")).alias("file_path"),
            F.lit(0).cast("bigint").alias("block"),
            "line_no",
            value.alias("value"),
        )
    )


@query(
    "detect_format",
    f"""WITH s AS ({S.syslog_lines(PACK)}), w AS ({S.access_lines(PACK)}),
m AS (SELECT 'mix-' || (user_id % 23) AS file_path, event_id,
  CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 23 < user_id % 23 THEN w.value ELSE s.value END AS value
  FROM events JOIN s ON s.line_no = event_id JOIN w ON w.line_no = event_id),
h AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY event_id) <= 20),
v AS (SELECT file_path, count(*) FILTER ({S.has("value", S.SYSLOG_LINE)}) AS s,
  count(*) FILTER ({S.has("value", S.ACCESS_LINE)} OR {S.has("value", S.ERROR_LINE)}) AS w
  FROM h GROUP BY file_path)
SELECT file_path, CASE WHEN w > s THEN 'web' ELSE 'syslog' END AS "format" FROM v""",
)
def q_detect_format(spark, sf_dir):
    return detect_formats(_mixed_lines(spark, sf_dir))


def _parsed_query(name: str, make: Query, fmt: str, parsed: str) -> None:
    cte = S.ctes(PACK)
    columns = [c for c in EVENT_COLUMNS if c != "datetime"]
    chosen = ", ".join(f'"{c}"' for c in [*LINE_KEYS, *columns])

    @query(name, f"{cte} SELECT {chosen} FROM ({parsed})")
    def run(spark, sf_dir):
        lines = log_lines(make(spark, sf_dir, PACK))
        return parse_lines(lines, fmt).select(*LINE_KEYS, *columns)


_parsed_query("parse_syslog", L.syslog_lines, "syslog", S.syslog_parsed("syslog_lines"))
_parsed_query("parse_access", L.access_lines, "web", S.access_parsed("access_lines"))
_parsed_query("parse_error", L.error_lines, "web", S.error_parsed("error_lines"))


@query("extract_ip", f"SELECT doc_id, {S.or_null(S.group('text', S.IPV4, 1))} AS ip FROM documents")
def q_extract_ip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", extract_ip(F.col("text")).alias("ip"))


MESSAGES = [
    "Failed password for invalid user @ from 10.0.0.1 port 22 ssh2",
    "Failed password for @ from 10.0.0.1",
    "Accepted password for @ from 10.0.0.2",
    "pam_unix(sshd:session): session opened for user @ by (uid=0)",
    "pam_unix(sshd:session): session closed for user @",
    "authentication failure; logname= uid=0 user=@",
    "authentication failure; ruser= rhost=10.1.1.1 user= @",
    "Invalid user @ from 10.0.0.3",
    "user : @ logged in, access granted",
    "Connection refused by @",
    "CRON started for user @",
    "error: bad protocol version",
    "Failed password for ",
    "session rejected, user @ is not allowed",
]
PROCESSES = ["sshd", "cron", "PAM-unix", "kernel", "sudo"]
_MESSAGE = f"replace({pick_sql(MESSAGES, 'event_id')}, '@', 'u' || user_id)"
_PROCESS = pick_sql(PROCESSES, "(event_id // 7)")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return L.events(spark, sf_dir).select(
        "event_id",
        F.replace(pick(MESSAGES, F.col("event_id")), F.lit("@"), user).alias("message"),
        pick(PROCESSES, F.floor(F.col("event_id") / 7).cast("bigint")).alias("process"),
    )


@query("extract_user", f"SELECT event_id, {S.user_of(_MESSAGE)} AS usuario FROM events")
def q_extract_user(spark, sf_dir):
    return _messages(spark, sf_dir).select("event_id", extract_user(F.col("message")).alias("usuario"))


@query("auth_status", f"SELECT event_id, {S.status_of(_MESSAGE, _PROCESS)} AS status FROM events")
def q_auth_status(spark, sf_dir):
    status = auth_status(F.col("message"), F.col("process"))
    return _messages(spark, sf_dir).select("event_id", status.alias("status"))


@query(
    "http_status_class",
    f"SELECT event_id, {S.status_class('(event_id % 600)')} AS status FROM events",
)
def q_http_status_class(spark, sf_dir):
    code = (F.col("event_id") % 600).cast("string")
    return L.events(spark, sf_dir).select("event_id", http_status_class(code).alias("status"))


_PAGE_URL = f"(url || {pick_sql(L.URLS, 'page_id')})"


@query("attack_tags", f"SELECT page_id, {S.tags_of(_PAGE_URL)} AS attack_types FROM pages")
def q_attack_tags(spark, sf_dir):
    url = F.concat("url", pick(L.URLS, F.col("page_id")))
    return table(spark, sf_dir, "pages").select("page_id", attack_tags(url).alias("attack_types"))


# (layout of the raw stamp, is it one of the known ones?)
STAMPS = [
    ("%d/%b/%Y:%H:%M:%S +0530", True),
    ("%d/%b/%Y:%H:%M:%S", True),
    ("%a %b %d %H:%M:%S.654321 %Y", True),
    ("%a %b %d %H:%M:%S %Y", True),
    ("%b %d %H:%M:%S %Y", True),
    ("%Y/%m/%d %H:%M:%S [more]", False),
    ("%d/Foo/%Y:%H:%M:%S +0000", False),
    ("[%d/%b/%Y:%H:%M:%S]", True),
]
_JAVA = {"%d": "dd", "%b": "MMM", "%Y": "yyyy", "%H": "HH", "%M": "mm", "%S": "ss", "%a": "EEE", "%m": "MM"}


def _java_layout(layout: str) -> str:
    out, i = "", 0
    while i < len(layout):
        two = layout[i : i + 2]
        out += _JAVA[two] if two in _JAVA else f"'{layout[i]}'"
        i += 2 if two in _JAVA else 1
    return out.replace("''", "")


@query(
    "normalize_ts",
    "SELECT event_id, CASE event_id % 8 "
    + " ".join(
        f"WHEN {i} THEN "
        + (
            "strftime(CAST(ts AS TIMESTAMP), '%b %d %H:%M:%S')"
            if known
            else f"substr(strftime(CAST(ts AS TIMESTAMP), {S.q(layout)}), 1, 20)"
        )
        for i, (layout, known) in enumerate(STAMPS)
    )
    + ' END AS "timestamp" FROM events',
)
def q_normalize_ts(spark, sf_dir):
    raw = F
    for i, (layout, _) in enumerate(STAMPS):
        raw = raw.when(F.col("event_id") % 8 == i, F.date_format("ts", _java_layout(layout)))
    stamps = L.events(spark, sf_dir).select("event_id", raw.alias("raw"))
    return stamps.select("event_id", normalize_timestamp(F.col("raw")).alias("timestamp"))


BAD_STAMPS = ["Feb 29 10:00:00", "Jan 32 10:00:00", "Jan 01 25:00:00", "nonsense", "Jun  5 03:04:05"]
_STAMP = (
    f"CASE WHEN event_id % 6 = 5 THEN {pick_sql(BAD_STAMPS, '(event_id // 6)')}"
    " ELSE strftime(CAST(ts AS TIMESTAMP), '%b %d %H:%M:%S') END"
)


@query(
    "parse_datetime",
    f"""WITH s AS (SELECT event_id, {_STAMP} AS stamp FROM events)
SELECT event_id, try_strptime('2024 ' || stamp, '%Y %b %d %H:%M:%S') AS "datetime" FROM s
WHERE try_strptime('1900 ' || stamp, '%Y %b %d %H:%M:%S') IS NOT NULL""",
)
def q_parse_datetime(spark, sf_dir):
    bad = pick(BAD_STAMPS, F.floor(F.col("event_id") / 6).cast("bigint"))
    stamp = F.when(F.col("event_id") % 6 == 5, bad).otherwise(F.date_format("ts", "MMM dd HH:mm:ss"))
    rows = L.events(spark, sf_dir).select(
        "event_id", stamp.alias("timestamp"), F.lit(None).cast("timestamp_ntz").alias("datetime")
    )
    return cast_times(rows, L.NOW).select("event_id", "datetime")


@query(
    "infer_year",
    f"""{S.ctes(L.PLAIN, "2024-01-15 00:00:00")} SELECT {KEYS}, "datetime" FROM syslog_events""",
)
def q_infer_year(spark, sf_dir):
    return L.syslog_events(spark, sf_dir, L.PLAIN, L.MID_JANUARY).select(*LINE_KEYS, "datetime")


_RAW_STAMP = f"CASE WHEN {S.has('value', S.ACCESS_LINE)} THEN {S.group('value', S.ACCESS_LINE, 4)} ELSE {S.group('value', S.ERROR_LINE, 1)} END"


@query(
    "keep_source_year",
    f"""{S.ctes(L.PLAIN)}, stamps AS (SELECT {KEYS}, {_RAW_STAMP} AS raw FROM web_lines
  WHERE {S.has("value", S.ACCESS_LINE)} OR {S.has("value", S.ERROR_LINE)})
SELECT {KEYS}, CASE WHEN contains(raw, '/') THEN strptime(substr(raw, 1, 20), '%d/%b/%Y:%H:%M:%S')
    ELSE strptime(substr(raw, 5, 15) || ' ' || right(raw, 4), '%b %d %H:%M:%S %Y') END AS "datetime",
  CASE WHEN contains(raw, '/') THEN substr(raw, 8, 4) ELSE right(raw, 4) END::INT AS source_year,
  CASE WHEN contains(raw, '/') THEN right(raw, 5) END AS source_offset FROM stamps""",
)
def q_keep_source_year(spark, sf_dir):
    """Web logs dated by the year they state, whatever the time of the analysis."""
    web = L.access_lines(spark, sf_dir, L.PLAIN).unionByName(L.error_lines(spark, sf_dir, L.PLAIN))
    events = cast_times(parse_lines(log_lines(web), "web", keep_source_year=True), L.MID_JANUARY)
    return events.select(*LINE_KEYS, "datetime", "source_year", "source_offset")


def _all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        L.syslog_lines(spark, sf_dir, PACK)
        .unionByName(L.access_lines(spark, sf_dir, PACK))
        .unionByName(L.error_lines(spark, sf_dir, PACK))
    )


@query(
    "canonical_events",
    f"{WITH} SELECT {KEYS}, " + ", ".join(f'"{c}"' for c in EVENT_COLUMNS) + " FROM every_event",
)
def q_canonical_events(spark, sf_dir):
    """Files of all kinds in one table, each read by the format found for it."""
    raw = _all_lines(spark, sf_dir)
    read = materialize(read_lines(raw))
    return cast_times(events_of(read, materialize(formats_of(read))), L.NOW)


_STATS = f"""{WITH}, n AS (SELECT file_path, value, {S.has("value", S.SYSLOG_LINE)} AS ok FROM syslog_lines
  UNION ALL SELECT file_path, value, {S.has("value", S.ACCESS_LINE)} OR {S.has("value", S.ERROR_LINE)}
  FROM web_lines),
st AS (SELECT file_path, count(*) AS lines_read, count(*) FILTER (ok) AS lines_parsed,
  count(*) FILTER (NOT ok) AS lines_discarded,
  count(*) FILTER (ok) / count(*) * 100 AS parse_rate FROM n GROUP BY file_path)
"""


@query("parse_stats", f"{_STATS} SELECT * FROM st")
def q_parse_stats(spark, sf_dir):
    raw = _all_lines(spark, sf_dir)
    read = materialize(read_lines(raw))
    return stats_of(read, materialize(formats_of(read)))


@query(
    "stats_report",
    f"{_STATS} SELECT file_path, lines_read, lines_parsed,"
    f" round_even(parse_rate, 2) AS parse_rate_percent, {S._texts(EVENT_COLUMNS)} AS extracted_fields FROM st",
)
def q_stats_report(spark, sf_dir):
    raw = _all_lines(spark, sf_dir)
    read = materialize(read_lines(raw))
    formats = materialize(formats_of(read))
    events = cast_times(events_of(read, formats), L.NOW)
    return stats_report(stats_of(read, formats), events)


# -------------------------------------------------------------- normalisation

_ESCAPES = ["%20%C3%A9", "+a+b%2Bc", "?q=%E2%82%AC%26x", "%zz%", "/100%", "#x%41%42", ""]


@query(
    "url_decode",
    f"SELECT page_id, {S.decoded('url || ' + pick_sql(_ESCAPES, 'page_id'))} AS url_decoded FROM pages",
)
def q_url_decode(spark, sf_dir):
    url = F.concat("url", pick(_ESCAPES, F.col("page_id")))
    return table(spark, sf_dir, "pages").select("page_id", url_decode(url).alias("url_decoded"))


@query("fill_nulls", f"{WITH} SELECT {KEYS}, usuario, ip_origen FROM evs")
def q_fill_nulls(spark, sf_dir):
    return L.all_events(spark, sf_dir, PACK).select(*LINE_KEYS, "usuario", "ip_origen")


# ---------------------------------------------------------------------- rules

FOUND = [*LINE_KEYS, "datetime", "ip_origen", "usuario", "accion", "status"]
_FOUND = ", ".join(f'"{c}"' for c in FOUND)


def _rule_query(name: str, make: Callable[[], Rule], label: str, pack: int = PACK) -> None:
    predicate, reason, severity = S.ROW_RULES[label]

    @query(
        name,
        f"{S.ctes(pack)} SELECT {_FOUND}, {reason} AS reason, {S.q(label)} AS rule,"
        f" {S.q(severity)} AS severity FROM evs WHERE {predicate}",
    )
    def run(spark, sf_dir):
        found = make().evaluate(L.all_events(spark, sf_dir, pack))
        return found.select(*FOUND, "reason", "rule", "severity")


_rule_query("rule_time_anomaly", time_anomaly, "Time Anomaly")
_rule_query("rule_sqli", sql_injection, "SQL Injection")
_rule_query("rule_xss", xss_attack, "XSS Attack")
_rule_query("rule_traversal", path_traversal, "Path Traversal")
_rule_query("rule_web_attack", web_attack, "Web Attack")


def _window_query(name: str, make: Callable[[], Rule], rows: str, label: str, reason: str, pack: int) -> None:
    @query(
        name,
        f"{S.ctes(pack)} SELECT {_FOUND}, {S.q(reason)} AS reason, {S.q(label)} AS rule,"
        f" 'high' AS severity FROM sys JOIN ({rows}) USING ({KEYS})",
    )
    def run(spark, sf_dir):
        # stored first, as an analysis does: the rule reads its events more than once
        found = make().evaluate(materialize(normalize(L.syslog_events(spark, sf_dir, pack))))
        return found.select(*FOUND, "reason", "rule", "severity")


_window_query(
    "rule_brute_force",
    brute_force,
    S.brute_force_rows("sys"),
    "Brute Force",
    S.BRUTE_FORCE_REASON,
    L.DENSE,
)
_window_query(
    "rule_user_probing", user_probing, S.probing_rows("sys"), "User Probing", S.PROBING_REASON, PACK
)


# ------------------------------------------------------------------- features


@query(
    "feat_rpm",
    f"{WITH_DENSE} {S.in_window('evs', 'true', 'count(*)', 60, False, 'requests_per_minute')}",
)
def q_feat_rpm(spark, sf_dir):
    counted = requests_per_minute(materialize(L.all_events(spark, sf_dir, L.DENSE)))
    return counted.select(*LINE_KEYS, "requests_per_minute")


_STATUS_VALUE = "CASE status WHEN 'SUCCESS' THEN 1.0::DOUBLE WHEN 'FAIL' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END"


@query(
    "feat_row",
    f"{WITH} SELECT {KEYS}, hour(\"datetime\")::INTEGER AS hour, {_STATUS_VALUE} AS status_val FROM evs",
)
def q_feat_row(spark, sf_dir):
    return L.all_events(spark, sf_dir, PACK).select(
        *LINE_KEYS, F.hour("datetime").alias("hour"), status_value(F.col("status")).alias("status_val")
    )


def _adler_sql(ip: str) -> str:
    codes = f"list_transform(str_split({ip}, ''), lambda c: ascii(c))"
    size = f"length({ip})"
    low = f"(1 + list_sum({codes})) % 65521"
    high = f"({size} + list_sum(list_transform({codes}, lambda c, i: ({size} - i + 1) * c))) % 65521"
    return f"(({high}) * 65536 + {low})::BIGINT"


@query("feat_ip_hash", f"{WITH} SELECT DISTINCT ip_origen, {_adler_sql('ip_origen')} AS ip_encoded FROM evs")
def q_feat_ip_hash(spark, sf_dir):
    sources = L.all_events(spark, sf_dir, PACK).select("ip_origen").distinct()
    return sources.withColumn("ip_encoded", adler32(F.col("ip_origen")))


_PER_IP = f"""SELECT ip_origen,
  CASE WHEN count(*) >= 5 THEN avg(CASE status WHEN 'FAIL' THEN 1.0 ELSE 0.0 END) ELSE 0.0 END::DOUBLE
    AS fail_ratio_per_ip,
  count(DISTINCT usuario) AS unique_users_per_ip, count(DISTINCT url) AS unique_urls_per_ip,
  {_adler_sql("ip_origen")} AS ip_encoded FROM evs GROUP BY ip_origen"""


@query(
    "feat_per_ip",
    f"{WITH} SELECT ip_origen, round(fail_ratio_per_ip, 9) AS fail_ratio_per_ip, unique_users_per_ip,"
    f" unique_urls_per_ip FROM ({_PER_IP})",
)
def q_feat_per_ip(spark, sf_dir):
    return per_source(L.all_events(spark, sf_dir, PACK)).select(
        "ip_origen",
        F.round("fail_ratio_per_ip", 9).alias("fail_ratio_per_ip"),
        "unique_users_per_ip",
        "unique_urls_per_ip",
    )


def _entropy_sql(source: str, key: str, text: str) -> str:
    """Over characters; rounded, as the order of summing differs."""
    return f"""SELECT {key}, round(0 - sum(n / total * log2(n / total)), 6) AS url_entropy FROM (
  SELECT *, sum(n) OVER (PARTITION BY {key}) AS total FROM (
  SELECT {key}, ch, count(*) AS n
  FROM (SELECT {key}, unnest(str_split({text}, '')) AS ch FROM {source}) GROUP BY {key}, ch)) GROUP BY {key}"""


@query("feat_entropy", _entropy_sql("documents", "doc_id", '"text"'))
def q_feat_entropy(spark, sf_dir):
    entropy = F.round(action_entropy(F.col("text")), 6)
    return table(spark, sf_dir, "documents").select("doc_id", entropy.alias("url_entropy"))


_FEATURES_SQL = f"""{WITH}, p AS ({_PER_IP}),
r AS ({S.in_window('evs', 'true', 'count(*)', 60, False, 'requests_per_minute')}),
e AS ({_entropy_sql("evs", KEYS, "accion")})
SELECT {KEYS}, hour("datetime")::INTEGER AS hour, ip_encoded, {_STATUS_VALUE} AS status_val,
  round(fail_ratio_per_ip, 9) AS fail_ratio_per_ip, unique_users_per_ip, requests_per_minute, url_entropy,
  unique_urls_per_ip
FROM evs JOIN p USING (ip_origen) JOIN r USING ({KEYS}) JOIN e USING ({KEYS})"""


@query("features_all", _FEATURES_SQL)
def q_features_all(spark, sf_dir):
    rounded = {"fail_ratio_per_ip": 9, "url_entropy": 6}
    return extract_features(materialize(L.all_events(spark, sf_dir, PACK))).select(
        *LINE_KEYS, *[F.round(c, rounded[c]).alias(c) if c in rounded else c for c in FEATURES]
    )


# -------------------------------------------------------------- anomaly model


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(extract_features(_stored(spark, sf_dir)))


# Every tree of a fitted forest: rows at its root and at all its leaves, and whether it
# keeps the bounds of the method (leaves at depth 8 at most, two nodes a row at most).
@query(
    "iforest_fit",
    f"""{WITH}, n AS (SELECT least(count(*), {iforest.SAMPLE}) AS rows FROM evs)
SELECT tree::INTEGER AS tree, rows AS root_rows, rows AS leaf_rows, true AS depth_kept, true AS size_kept
FROM n, range({iforest.TREES}) AS t(tree)""",
)
def q_iforest_fit(spark, sf_dir):
    leaf = F.col("left") == F.col("node")
    root = F.col("node") == 0
    return iforest.fit_nodes(_features(spark, sf_dir)).groupBy("tree").agg(
        F.sum(F.when(root, F.col("rows"))).alias("root_rows"),
        F.sum(F.when(leaf, F.col("rows"))).alias("leaf_rows"),
        (F.max("depth") <= 8).alias("depth_kept"),
        (F.count(F.lit(1)) < 2 * F.max(F.when(root, F.col("rows")))).alias("size_kept"),
    )


# A small forest that both engines get as it stands: (tree, node, feature, threshold, left,
# right, path). Thresholds lie between the values that occur.
_TREES = [
    (0, 0, 0, 8.5, 1, 2, 0.0), (0, 1, 6, 3.9017, 3, 4, 0.0), (0, 2, 3, 0.30003, 5, 6, 0.0),
    (0, 3, 0, 0.0, 3, 3, 2.0), (0, 4, 0, 0.0, 4, 4, 3.5), (0, 5, 5, 2.5, 7, 8, 0.0), (0, 6, 0, 0.0, 6, 6, 2.25),
    (0, 7, 0, 0.0, 7, 7, 4.75), (0, 8, 0, 0.0, 8, 8, 3.0),
    (1, 0, 2, 0.75, 1, 2, 0.0), (1, 1, 4, 5.5, 3, 4, 0.0), (1, 2, 7, 11.5, 5, 6, 0.0),
    (1, 3, 0, 0.0, 3, 3, 3.25), (1, 4, 0, 0.0, 4, 4, 4.5), (1, 5, 0, 0.0, 5, 5, 2.0), (1, 6, 0, 0.0, 6, 6, 5.0),
    (2, 0, 1, 200000000.5, 1, 2, 0.0), (2, 1, 0, 0.0, 1, 1, 1.0), (2, 2, 0, 15.5, 3, 4, 0.0),
    (2, 3, 0, 0.0, 3, 3, 5.5), (2, 4, 6, 4.2021, 5, 6, 0.0), (2, 5, 0, 0.0, 5, 5, 3.0), (2, 6, 0, 0.0, 6, 6, 4.0),
]
_TREE_SAMPLE, _TREE_QUANTILE = 8, 0.9


def _small_forest(cutoff: float | None = None) -> iforest.Forest:
    columns = ["tree", "node", "feature", "threshold", "left", "right", "path"]
    return iforest.Forest(pd.DataFrame(_TREES, columns=columns), tuple(FEATURES), _TREE_SAMPLE, cutoff)


_NODES = ", ".join(str(n) for n in _TREES)
_NORM = float(iforest.average_path(_TREE_SAMPLE))
_X = ", ".join(f"{c}::DOUBLE" for c in FEATURES)


def _with_scores() -> str:
    """CTEs up to ``scored``: every event walks down every tree."""
    head, body = _FEATURES_SQL.split("\nSELECT", 1)
    return f"""{head.replace("WITH ", "WITH RECURSIVE ", 1)}, f AS (SELECT {body}),
x AS (SELECT {KEYS}, [{_X}] AS x FROM f),
nodes(tree, node, feature, threshold, "left", "right", path) AS (VALUES {_NODES}),
walk AS (SELECT {KEYS}, x, tree, 0 AS node, 0 AS depth FROM x, (SELECT DISTINCT tree FROM nodes)
  UNION ALL SELECT {KEYS}, x, tree, CASE WHEN x[feature + 1] <= threshold THEN "left" ELSE "right" END, depth + 1
  FROM walk JOIN nodes USING (tree, node) WHERE depth < 3),
scored AS (SELECT {KEYS}, pow(2.0::DOUBLE, -sum(path::DOUBLE) / {len({n[0] for n in _TREES})} / {_NORM!r}::DOUBLE) AS score
  FROM walk JOIN nodes USING (tree, node) WHERE depth = 3 GROUP BY {KEYS}),
cut AS (SELECT quantile_cont(score, {_TREE_QUANTILE}) AS cutoff FROM scored)"""


_SCORED = _with_scores()


def _scored(features: DataFrame) -> tuple[DataFrame, iforest.Forest]:
    """The scores beside all columns of ``features``, and the forest with its cut-off."""
    scored = materialize(iforest.score(features, _small_forest()))
    return scored, _small_forest(iforest.exact_quantile(scored, "score", _TREE_QUANTILE))


@query("iforest_score", f"{_SCORED} SELECT {KEYS}, round(score, 9) AS score, score > cutoff AS outlier FROM scored, cut")
def q_iforest_score(spark, sf_dir):
    scored, forest = _scored(_features(spark, sf_dir))
    return scored.select(*LINE_KEYS, F.round("score", 9).alias("score"), iforest.is_outlier(forest).alias("outlier"))


@query(
    "iforest_threshold",
    f"{_SCORED} SELECT round(cutoff, 9) AS cutoff, count(*) FILTER (score > cutoff) AS flagged, count(*) AS rows"
    " FROM scored, cut GROUP BY cutoff",
)
def q_iforest_threshold(spark, sf_dir):
    scored, forest = _scored(_features(spark, sf_dir))
    return scored.agg(
        F.round(F.lit(forest.cutoff), 9).alias("cutoff"),
        F.count_if(iforest.is_outlier(forest)).alias("flagged"),
        F.count(F.lit(1)).alias("rows"),
    )


@query(
    "rule_iforest",
    f"{_SCORED} SELECT {_FOUND}, 'Isolation Forest Anomaly' AS reason, 'Isolation Forest Anomaly' AS rule,"
    f" 'low' AS severity FROM evs JOIN scored USING ({KEYS}), cut WHERE score > cutoff",
)
def q_rule_iforest(spark, sf_dir):
    events = _stored(spark, sf_dir)
    forest = _scored(extract_features(events))[1]
    found = iforest.isolation_forest_rule(forest).evaluate(events)
    return found.select(*FOUND, "reason", "rule", "severity")


# --------------------------------------------------------- detection, reports


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events parsed once and kept, as an analysis does before it applies the rules."""
    return materialize(L.all_events(spark, sf_dir, PACK))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Detector().alerts(_stored(spark, sf_dir))


WITH_ALERTS = f"{WITH}, alerts AS ({S.alerts('evs')})"
_ALERT_COLUMNS = ["datetime", "ip_origen", "usuario", "accion", "status", "reason", "rule", "severity", "timestamp"]
_ALERTS = ", ".join(f'"{c}"' for c in _ALERT_COLUMNS)


@query("detect_hits", f"{WITH} {S.hits('evs')}")
def q_detect_hits(spark, sf_dir):
    """Findings one by one, before they are merged."""
    found = Detector().findings(_stored(spark, sf_dir))
    return found.select(*LINE_KEYS, "ord", "rule", "reason", "severity")


@query("detect_alerts", f"{WITH_ALERTS} SELECT {_ALERTS} FROM alerts")
def q_detect_alerts(spark, sf_dir):
    return Detector().run(_stored(spark, sf_dir))


@query(
    "detect_first_reasons",
    f"""{S.ctes(L.DENSE)}, who AS (SELECT * REPLACE (NULL::VARCHAR AS usuario, 'a visit' AS accion, 'INFO' AS status) FROM web)
{S.first_reasons("who", "'Asked by ' || user_agent", "user_agent IS NOT NULL")}""",
)
def q_detect_first_reasons(spark, sf_dir):
    """A rule whose reason is told by the row: several reasons in one alert."""
    rule = RowRule(
        "Any Visit", "low", ("user_agent",),
        predicate=lambda df: F.col("user_agent").isNotNull(),
        reason=lambda: F.concat(F.lit("Asked by "), "user_agent"),
    )
    visits = normalize(L.web_events(spark, sf_dir, L.DENSE)).withColumns(
        {"usuario": F.lit(None).cast("string"), "accion": F.lit("a visit"), "status": F.lit("INFO")}
    )
    events = materialize(visits)
    return Detector([rule]).alerts(events).select(*ALERT_KEYS, "reason")


@query("alert_severity", f"{WITH_ALERTS} SELECT {S.KEYS}, severity FROM alerts")
def q_alert_severity(spark, sf_dir):
    return _alerts(spark, sf_dir).select(*ALERT_KEYS, "severity")


_TIME_TEXT = "strftime(\"datetime\", '%Y-%m-%d %H:%M:%S')"


@query(
    "alert_records",
    f"{WITH_ALERTS}, shown AS (SELECT * REPLACE ({_TIME_TEXT} AS \"datetime\") FROM alerts)"
    f" SELECT {_ALERTS}, json_object("
    + ", ".join(f"{S.q(c)}, \"{c}\"" for c in _ALERT_COLUMNS)
    + ")::VARCHAR AS record FROM shown",
)
def q_alert_records(spark, sf_dir):
    return alert_records(_alerts(spark, sf_dir).select(*_ALERT_COLUMNS))


_TOTALS = (
    "SELECT (SELECT count(*) FROM evs) AS total_logs, (SELECT count(*) FROM alerts) AS total_anomalies"
)


@query("kpi", f"{WITH_ALERTS} {_TOTALS}")
def q_kpi(spark, sf_dir):
    events = _stored(spark, sf_dir)
    return totals(events, Detector().alerts(events))


@query(
    "threat_level",
    f"""{WITH_ALERTS}, t AS ({_TOTALS}) SELECT *, CASE WHEN total_logs = 0 THEN 'LOW'
  WHEN total_anomalies / total_logs > 0.05 OR total_anomalies > 50 THEN 'HIGH'
  WHEN total_anomalies / total_logs > 0.01 OR total_anomalies > 5 THEN 'ELEVATED' ELSE 'LOW' END
  AS threat_level FROM t""",
)
def q_threat_level(spark, sf_dir):
    events = _stored(spark, sf_dir)
    return threat_level(totals(events, Detector().alerts(events)))


@query(
    "top_actors",
    f"{WITH_ALERTS} SELECT ip_origen, count(*) AS hits FROM alerts WHERE ip_origen IS NOT NULL"
    " GROUP BY ip_origen ORDER BY hits DESC, ip_origen LIMIT 5",
)
def q_top_actors(spark, sf_dir):
    return top_actors(_alerts(spark, sf_dir))


@query(
    "hourly_intensity",
    f"""{S.ctes(L.PLAIN)}, c AS (SELECT date_trunc('hour', "datetime") AS h, count(*) AS n FROM sys GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(h) FROM c), (SELECT max(h) FROM c), INTERVAL 1 HOUR)) AS h)
SELECT s.h::TIMESTAMP AS "datetime", coalesce(n, 0) AS events FROM s LEFT JOIN c ON s.h = c.h""",
)
def q_hourly_intensity(spark, sf_dir):
    return hourly_intensity(L.syslog_events(spark, sf_dir, L.PLAIN))


def _escaped(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {S.q(raw)}, {S.q(safe)})"
    return text


def _preview_sql(text: str) -> str:
    safe = _escaped(text)
    return f"CASE WHEN length({safe}) > 65 THEN substr({safe}, 1, 65) || '...' ELSE {safe} END"


@query(
    "forensic_view",
    f"""{WITH_ALERTS}, tail AS (SELECT * FROM evs ORDER BY file_path DESC, block DESC, line_no DESC LIMIT 200),
last AS (SELECT "datetime", ip_origen, arg_max(rule, (usuario, accion, status)) AS rule,
  arg_max(severity, (usuario, accion, status)) AS severity FROM alerts GROUP BY 1, 2)
SELECT {KEYS}, status, {_TIME_TEXT} AS time_text,
  CASE WHEN rule IS NULL THEN '' ELSE '[' || upper(rule) || ']' END AS label, upper(severity) AS severity,
  {_preview_sql("accion")} AS action_preview, {_escaped("ip_origen")} AS source
FROM tail LEFT JOIN last USING ("datetime", ip_origen)""",
)
def q_forensic_view(spark, sf_dir):
    events = _stored(spark, sf_dir)
    return forensic_view(events, Detector().alerts(events))


@query("action_preview", f'SELECT doc_id, {_preview_sql(chr(34) + "text" + chr(34))} AS action_preview FROM documents')
def q_action_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("action_preview"))


# Report records with one level of nesting, made from the events.
_NESTED = f"SELECT event_id, {S.IP} AS ip_origen, user_id, event_type, [event_type, 'u' || user_id] AS tags FROM events"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.events(spark, sf_dir).select(
        "event_id",
        F.struct(L._ip().alias("ip_origen"), "user_id").alias("actor"),
        F.array("event_type", L._user()).alias("tags"),
    )


_FLAT = (
    "SELECT event_id, ip_origen AS actor_ip_origen, user_id AS actor_user_id,"
    f" array_to_string(tags, ', ') AS tags FROM ({_NESTED})"
)


@query("flatten_records", _FLAT)
def q_flatten_records(spark, sf_dir):
    return flatten_records(_nested(spark, sf_dir))


@query("export_json", _FLAT)
def q_export_json(spark, sf_dir):
    """Written as a JSON report and read back."""
    records = _nested(spark, sf_dir)
    path = export_json(records, scratch_folder(spark), "events")
    back = spark.read.schema(records.schema).json(f"{path}/threats")
    return flatten_records(back)


@query("export_csv", _FLAT)
def q_export_csv(spark, sf_dir):
    """Written as a CSV report and read back."""
    records = _nested(spark, sf_dir)
    path = export_csv(records, scratch_folder(spark), "events")
    return spark.read.schema(flatten_records(records).schema).csv(path, header=True, escape='"')


# The rows of a report as one JSON document; SQL writes each record the same way.
@query(
    "json_report",
    f"""WITH r AS (SELECT event_id, {S.IP} AS ip_origen, user_id, event_type FROM events)
SELECT 1 AS part, json_object('event_id', event_id, 'actor', json_object('ip_origen', ip_origen, 'user_id', user_id),
  'event_type', event_type)::VARCHAR AS record FROM r
UNION ALL SELECT 0, '{{"export_metadata": {{"timestamp": "2024-12-31T23:59:59", "format": "json", "record_count": '
  || count(*) || '}}, "threats": [' FROM r
UNION ALL SELECT 2, ']}}'""",
)
def q_json_report(spark, sf_dir):
    actor = F.struct(L._ip().alias("ip_origen"), "user_id").alias("actor")
    parts = json_document(L.events(spark, sf_dir).select("event_id", actor, "event_type"), L.NOW)
    # which record comes first, and so has no comma before it, is not SQL's to say
    return parts.select("part", F.regexp_replace("text", "^, ", "").alias("record"))


# Records with a map, lists and structs below the first level.
_DEEP = """SELECT event_id, {'kind': event_type, 'ids': [user_id, event_id]} AS deep FROM events"""


@query(
    "export_csv_nested",
    f"""SELECT event_id, deep.kind AS deep_kind, to_json(deep.ids)::VARCHAR AS deep_ids,
  CASE WHEN event_id % 2 = 0 THEN deep.kind END AS more_even, CASE WHEN event_id % 2 = 1 THEN deep.kind END AS more_odd
FROM ({_DEEP})""",
)
def q_export_csv_nested(spark, sf_dir):
    """Written as a CSV report and read back."""
    key = F.when(F.col("event_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    records = L.events(spark, sf_dir).select(
        "event_id",
        F.struct(F.col("event_type").alias("kind"), F.array("user_id", "event_id").alias("ids")).alias("deep"),
        F.create_map(key, F.col("event_type")).alias("more"),
    )
    path = export_csv(records, scratch_folder(spark), "events")
    return spark.read.schema(flatten_records(records).schema).csv(path, header=True, escape='"')
