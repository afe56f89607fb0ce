"""DuckDB statements with the same meaning as the registered queries.

Each statement builds the log lines from ``events`` by itself and parses that text
with its own regular expressions.
"""

from __future__ import annotations

from duskwatch.operators.rules import SQL_PATTERNS, TRAVERSAL_PATTERNS, XSS_PATTERNS
from duskwatch.schema import EVENT_COLUMNS
from duskwatch.sources.formats import (
    ACCESS_LINE,
    AUTH_FAIL,
    AUTH_SUCCESS,
    ERROR_LINE,
    FAIL_TERMS,
    IPV4,
    SUCCESS_TERMS,
    SYSLOG_LINE,
    URL_TAGS,
    USER_PATTERNS,
)

from .lines import AGENTS, STATUS, URLS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _texts(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


IP = "'10.0.' || (user_id // 6) // 250 || '.' || (user_id // 6) % 250"


def moment(pack: int) -> str:
    micros = "date_diff('microsecond', TIMESTAMP '2024-01-01', CAST(ts AS TIMESTAMP))"
    return f"(TIMESTAMP '2024-01-01' + to_seconds({micros} // {1_000_000 * pack}))"


def _line_table(prefix: str, text: str) -> str:
    return f"""SELECT {q(prefix)} || (event_id % 4) || '.log' AS file_path, 0::BIGINT AS block,
  event_id AS line_no,
  CASE WHEN event_id % 97 = 0 THEN '-- no known format --' ELSE {text} END AS value
  FROM events"""


def syslog_lines(pack: int) -> str:
    text = f"""strftime({moment(pack)}, '%b %d %H:%M:%S') || ' host' || (user_id % 3) ||
    CASE WHEN event_type = 'purchase' THEN ' kernel: '
         ELSE ' sshd[' || (event_id % 9000 + 100) || ']: ' END ||
    CASE event_type
      WHEN 'error' THEN 'Failed password for u' || user_id || ' from ' || {IP}
      WHEN 'signup' THEN 'Accepted password for u' || user_id || ' from ' || {IP}
      WHEN 'click' THEN 'session opened for user u' || user_id || ' from ' || {IP}
      WHEN 'view' THEN 'Failed password for invalid user u' || user_id || ' from ' || {IP}
      ELSE 'connection reset by peer' END"""
    return _line_table("auth-", text)


def access_lines(pack: int) -> str:
    urls = _texts([u.replace(" ", "+") for u in URLS])
    codes = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in STATUS.items())
    text = f"""{IP} || ' - ' ||
    CASE WHEN event_type = 'view' THEN '-' ELSE 'u' || user_id END || ' [' ||
    strftime({moment(pack)}, '%d/%b/%Y:%H:%M:%S') || ' +0200] "' ||
    CASE WHEN event_id % 5 = 0 THEN 'POST ' ELSE 'GET ' END ||
    {urls}[event_id % {len(URLS)} + 1] || ' HTTP/1.1" ' || CASE event_type {codes} END || ' ' ||
    CASE WHEN event_id % 11 = 0 THEN '-' ELSE CAST(event_id % 5000 AS VARCHAR) END ||
    ' "https://example.com/p' || (event_id % 3) || '" "' ||
    {_texts(AGENTS)}[event_id % {len(AGENTS)} + 1] || '"'"""
    return _line_table("access-", text)


def error_lines(pack: int) -> str:
    text = f"""'[' || strftime({moment(pack)}, '%a %b %d %H:%M:%S') ||
    CASE WHEN event_id % 2 = 0 THEN '.123456' ELSE '' END || ' 2024] [error] ' ||
    CASE WHEN event_id % 3 = 0 THEN '[pid ' || (event_id % 777) || '] ' ELSE '' END ||
    CASE WHEN event_id % 5 <> 0 THEN '[client ' || {IP} || ':4711] ' ELSE '' END ||
    'File does not exist: /var/www/' || event_type"""
    return _line_table("error-", text)


def has(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {q(pattern)}{', ' + q(flags) if flags else ''})"


def group(text: str, pattern: str, n: int, flags: str = "") -> str:
    return f"regexp_extract({text}, {q(pattern)}, {n}{', ' + q(flags) if flags else ''})"


def or_null(text: str) -> str:
    return f"nullif({text}, '')"


def user_of(text: str) -> str:
    return "coalesce(" + ", ".join(or_null(group(text, p, 1, "i")) for p in USER_PATTERNS) + ")"


def _any_term(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(t)})" for t in terms) + ")"


def status_of(message: str, process: str) -> str:
    low = f"lower({message})"
    login = _any_term(f"lower({process})", ["pam", "sshd"])
    return f"""CASE WHEN {login} AND {has(low, AUTH_SUCCESS)} THEN 'SUCCESS'
    WHEN {login} AND {has(low, AUTH_FAIL)} THEN 'FAIL'
    WHEN {_any_term(low, FAIL_TERMS)} THEN 'FAIL'
    WHEN {_any_term(low, SUCCESS_TERMS)} THEN 'SUCCESS' ELSE 'INFO' END"""


def syslog_parsed(lines: str) -> str:
    """The canonical columns but ``datetime`` from a table of lines."""
    g = [group("value", SYSLOG_LINE, n) for n in range(6)]
    return f"""SELECT file_path, block, line_no, {g[1]} AS "timestamp", {g[2]} AS hostname,
  {g[3]} AS process, {or_null(g[4])} AS pid, {or_null(group(g[5], IPV4, 1))} AS ip_origen,
  {user_of(g[5])} AS usuario, {g[5]} AS accion, {status_of(g[5], g[3])} AS status,
  NULL::VARCHAR AS "method", NULL::VARCHAR AS url, NULL::VARCHAR AS http_status,
  NULL::VARCHAR AS user_agent, NULL::VARCHAR AS referer, NULL::VARCHAR[] AS attack_types,
  NULL::VARCHAR AS bytes_sent, NULL::VARCHAR AS log_level
  FROM {lines} WHERE {has("value", SYSLOG_LINE)}"""


# The user agent is group 10, which regexp_extract cannot name: a pattern of its own.
AGENT = ACCESS_LINE.replace("(", "(?:", 9)
AGENT_LAST = r'"([^"]*)"$'


def web_time(raw: str) -> str:
    """For the stamps of the fixture only: both layouts, all of them valid."""
    access = f"strftime(try_strptime({raw}, '%d/%b/%Y:%H:%M:%S %z'), '%b %d %H:%M:%S')"
    return f"""CASE WHEN contains({raw}, '/') THEN substr({raw}, 4, 3) || ' ' || substr({raw}, 1, 2) || ' ' ||
    substr({raw}, 13, 8) ELSE substr({raw}, 5, 15) END"""


def status_class(code: str) -> str:
    return f"CASE WHEN {code}::INT >= 400 THEN 'FAIL' WHEN {code}::INT >= 200 THEN 'SUCCESS' ELSE 'INFO' END"


def tags_of(url: str) -> str:
    ((tag, pattern),) = URL_TAGS.items()
    return f"CASE WHEN {has(url, pattern, 'i')} THEN [{q(tag)}] END"


def access_parsed(lines: str) -> str:
    g = [group("value", ACCESS_LINE, n) for n in range(10)]
    agent = group("value", AGENT_LAST, 1)
    return f"""SELECT file_path, block, line_no, {web_time(g[4])} AS "timestamp", '-' AS hostname,
  'web_server' AS process, NULL::VARCHAR AS pid, {g[1]} AS ip_origen, nullif({g[3]}, '-') AS usuario,
  {g[5]} || ' ' || {g[6]} AS accion, {status_class(g[7])} AS status, {g[5]} AS "method", {g[6]} AS url,
  {g[7]} AS http_status, {agent} AS user_agent, {g[9]} AS referer, {tags_of(g[6])} AS attack_types,
  {g[8]} AS bytes_sent, NULL::VARCHAR AS log_level
  FROM {lines} WHERE {has("value", ACCESS_LINE)}"""


def error_parsed(lines: str) -> str:
    g = [group("value", ERROR_LINE, n) for n in range(6)]
    return f"""SELECT file_path, block, line_no, {web_time(g[1])} AS "timestamp", '-' AS hostname,
  'web_server' AS process, {or_null(g[3])} AS pid, nullif(split_part({g[4]}, ':', 1), '') AS ip_origen,
  NULL::VARCHAR AS usuario, {g[5]} AS accion, 'FAIL' AS status, NULL::VARCHAR AS "method",
  NULL::VARCHAR AS url, NULL::VARCHAR AS http_status, NULL::VARCHAR AS user_agent,
  NULL::VARCHAR AS referer, NULL::VARCHAR[] AS attack_types, NULL::VARCHAR AS bytes_sent,
  {g[2]} AS log_level
  FROM {lines} WHERE {has("value", ERROR_LINE)} AND NOT {has("value", ACCESS_LINE)}"""


def timed(parsed: str, now: str = "2024-12-31 23:59:59") -> str:
    """All canonical columns in order; rows without a valid time are left out."""
    year = int(now[:4])
    at = [f"try_strptime({y} || ' ' || \"timestamp\", '%Y %b %d %H:%M:%S')" for y in (year, year - 1)]
    common = "try_strptime('1900 ' || \"timestamp\", '%Y %b %d %H:%M:%S')"
    columns = ", ".join(f'"{c}"' for c in EVENT_COLUMNS if c not in ("timestamp", "datetime"))
    return f"""SELECT file_path, block, line_no, "timestamp",
  CASE WHEN {at[0]} <= TIMESTAMP '{now}' THEN {at[0]} ELSE {at[1]} END AS "datetime", {columns}
  FROM {parsed} WHERE {common} IS NOT NULL"""


def decoded(url: str) -> str:
    """For URLs whose escapes are all valid UTF-8; other escapes stay as they are."""
    return f"url_decode(replace(coalesce({url}, ''), '+', ' '))"


def normalized(events: str) -> str:
    return f"""SELECT * REPLACE (coalesce(usuario, '-') AS usuario, coalesce(ip_origen, '0.0.0.0') AS ip_origen),
  {decoded("url")} AS url_decoded FROM {events}"""


def ctes(pack: int, now: str = "2024-12-31 23:59:59") -> str:
    """WITH list: lines, parsed lines, events and normalised events of both kinds."""
    return f"""WITH syslog_lines AS ({syslog_lines(pack)}),
access_lines AS ({access_lines(pack)}), error_lines AS ({error_lines(pack)}),
web_lines AS (SELECT * FROM access_lines UNION ALL SELECT * FROM error_lines),
syslog_parsed AS ({syslog_parsed("syslog_lines")}),
web_parsed AS ({access_parsed("web_lines")} UNION ALL {error_parsed("web_lines")}),
syslog_events AS ({timed("syslog_parsed", now)}), web_events AS ({timed("web_parsed", now)}),
every_event AS (SELECT * FROM syslog_events UNION ALL SELECT * FROM web_events),
sys AS ({normalized("syslog_events")}), web AS ({normalized("web_events")}),
evs AS ({normalized("every_event")})
"""


# --------------------------------------------------------------------- rules


def any_pattern(text: str, patterns: list[str]) -> str:
    return has(text, "|".join(f"({p})" for p in patterns), "i")


# Names, reasons and severities of the rules, as reports show them.
ROW_RULES = {
    "Time Anomaly": (
        "status = 'SUCCESS' AND (hour(\"datetime\") < 8 OR hour(\"datetime\") >= 18)",
        "'Time Anomaly: Login outside business hours'",
        "medium",
    ),
    "SQL Injection": (any_pattern("url_decoded", SQL_PATTERNS), "'Detected by SQL Injection'", "high"),
    "XSS Attack": (
        f"({any_pattern('url_decoded', XSS_PATTERNS)} OR coalesce({any_pattern('user_agent', XSS_PATTERNS)}, false))",
        "'Detected by XSS Attack'",
        "medium",
    ),
    "Path Traversal": (
        any_pattern("url_decoded", TRAVERSAL_PATTERNS),
        "'Detected by Path Traversal'",
        "high",
    ),
    "Web Attack": (
        "attack_types IS NOT NULL",
        "'Detected by Web Attack: ' || array_to_string(attack_types, ', ')",
        "medium",
    ),
}
BRUTE_FORCE_REASON = "Brute Force: Threshold reached (6+ failed logins)"
PROBING_REASON = "User Probing: Threshold reached (4+ unique users in 10min)"
ORDER = "file_path, block, line_no"


def in_window(table: str, where: str, what: str, seconds: int, closed: bool, name: str) -> str:
    """Per row: ``what`` over the address's rows in its window, earlier ones by position."""
    edge = ">=" if closed else ">"
    return f"""SELECT r.file_path, r.block, r.line_no, {what} AS {name}
  FROM {table} r JOIN {table} o ON o.ip_origen = r.ip_origen
   AND o."datetime" {edge} r."datetime" - INTERVAL {seconds} SECOND
   AND (o."datetime" < r."datetime" OR (o."datetime" = r."datetime"
        AND (o.file_path, o.block, o.line_no) <= (r.file_path, r.block, r.line_no)))
  WHERE {where} GROUP BY ALL"""


def brute_force_rows(table: str) -> str:
    where = "r.status = 'FAIL' AND o.status = 'FAIL'"
    return f"SELECT * FROM ({in_window(table, where, 'count(*)', 60, True, 'n')}) WHERE n >= 6"


def probing_rows(table: str) -> str:
    # The number of different users up to the row, counted within the same window.
    what = "count(DISTINCT o.usuario)"
    return f"SELECT * FROM ({in_window(table, 'true', what, 600, True, 'n')}) WHERE n >= 4"


def hits(table: str) -> str:
    """(line keys, ord, rule, reason, severity) of every finding."""
    names = ["Brute Force", "Time Anomaly", "User Probing", "SQL Injection", "XSS Attack",
             "Path Traversal", "Web Attack"]
    parts = [
        f"SELECT {ORDER}, 0 AS ord, 'Brute Force' AS rule, {q(BRUTE_FORCE_REASON)} AS reason, 'high' AS severity"
        f" FROM ({brute_force_rows(table)})",
        f"SELECT {ORDER}, 2 AS ord, 'User Probing' AS rule, {q(PROBING_REASON)} AS reason, 'high' AS severity"
        f" FROM ({probing_rows(table)})",
    ]
    for name, (predicate, reason, severity) in ROW_RULES.items():
        parts.append(
            f"SELECT {ORDER}, {names.index(name)} AS ord, {q(name)} AS rule, {reason} AS reason,"
            f" {q(severity)} AS severity FROM {table} WHERE {predicate}"
        )
    return " UNION ALL ".join(parts)


KEYS = '"datetime", ip_origen, usuario, accion, status'


def first_reasons(table: str, reason: str, where: str) -> str:
    """Alerts of one rule, its different reasons in order of the first line that has them."""
    return f"""SELECT {KEYS}, string_agg(reason, ' | ' ORDER BY first) AS reason FROM (
  SELECT {KEYS}, {reason} AS reason, min((file_path, block, line_no)) AS first FROM {table} WHERE {where} GROUP BY ALL)
  GROUP BY {KEYS}"""


def alerts(table: str) -> str:
    """One row per alert; texts of one rule do not differ inside an alert (but see first_reasons)."""
    return f"""SELECT {KEYS}, string_agg(reason, ' | ' ORDER BY ord) AS reason,
  string_agg(rule, ' | ' ORDER BY ord) AS rule,
  CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity,
  arg_min("timestamp", (ord, first)) AS "timestamp"
  FROM (SELECT {KEYS}, ord, rule, reason,
    max(CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS rank,
    min((file_path, block, line_no)) AS first,
    arg_min("timestamp", (file_path, block, line_no)) AS "timestamp"
    FROM ({hits(table)}) JOIN {table} USING ({ORDER}) GROUP BY ALL)
  GROUP BY {KEYS}"""
