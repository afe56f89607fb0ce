"""Log formats as data: a pattern per line shape and columns made of its groups.

A format is applied with one regex evaluation per line. The replacement text lists
the captured groups one per line (a log line holds no line feed), so a single
``split`` yields all of them instead of one ``regexp_extract`` per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.regex import first_group, java_regex
from duskwatch.functions.timestamps import normalize_timestamp, source_offset, source_year

Groups = Callable[[int], Column]


@dataclass(frozen=True)
class LineShape:
    """A pattern for the start of a line, its ``groups`` captures and their columns."""

    pattern: str
    groups: int
    columns: Callable[[Groups], dict[str, Column]]

    @property
    def regex(self) -> str:
        return java_regex(rf"^(?:{self.pattern})")

    def whole_line(self) -> str:
        # A tagged line (see LogFormat.captures) starts with a line feed: no match.
        return java_regex(rf"^(?!\n)(?:{self.pattern})[\s\S]*")


@dataclass(frozen=True)
class LogFormat:
    """A named set of line shapes, tried in order."""

    name: str
    shapes: tuple[LineShape, ...]

    def matches(self, line: Column) -> Column:
        hit = F.lit(False)
        for shape in self.shapes:
            hit = hit | line.rlike(shape.regex)
        return hit

    def captures(self, line: Column, first: int = 0) -> Column:
        """Captured groups as one text; the line itself if no shape matches.

        A match gives a line feed, the shape number (counted from ``first``), and
        the groups, each on its own line.
        """
        for number, shape in enumerate(self.shapes, first):
            slots = "".join(f"\n${g}" for g in range(1, shape.groups + 1))
            line = F.regexp_replace(line, shape.whole_line(), f"\n{number}{slots}")
        return line

    def parse(self, lines: DataFrame, text: str = "value") -> DataFrame:
        """The lines this format knows, ``text`` replaced by the parsed columns."""
        return columns_of(lines, text, self.captures(F.col(text)), self.shapes)


def columns_of(
    lines: DataFrame, text: str, captured: Column, shapes: Sequence[LineShape]
) -> DataFrame:
    """Turn captured groups into columns; lines without a match are left out."""
    keep = [c for c in lines.columns if c != text]
    # Behind explode() the filter below is not pushed into a second regex pass.
    found = lines.select(*keep, F.explode(F.array(F.split(captured, "\n"))).alias("_got"))
    found = found.where(F.size("_got") > 1)

    def group(n: int) -> Column:
        return F.col("_got")[n + 1]

    made = [shape.columns(group) for shape in shapes]
    columns = []
    for name in dict.fromkeys(c for m in made for c in m):
        pick = F
        for number, m in enumerate(made):
            if name in m:
                pick = pick.when(F.col("_got")[1] == str(number), m[name])
        columns.append((made[0][name] if len(made) == 1 else pick).alias(name))
    return found.select(*keep, *columns)


def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# ---------------------------------------------------------------- system log

# Patterns of the system-log line and of what its message tells.
SYSLOG_LINE = (
    r"^([A-Z][a-z]{2}\s+\d+\s\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)$"
)
IPV4 = r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)"
USER_PATTERNS = [
    r"invalid\s+user\s+(\S+)",
    r"failed\s+password\s+(?:for\s+)?(?:invalid\s+user\s+)?(\S*)",
    r"accepted\s+password\s+for\s+(\S+)",
    r"session\s+opened\s+for\s+user\s+(\S+)",
    r"session\s+closed\s+for\s+user\s+(\S+)",
    r"(?:user\s+(?:'='?'?)?|for\s+(?:invalid\s+)?user\s+|user\s*[=:]\s*)([a-zA-Z0-9_.-]+)",
]
AUTH_PROCESSES = ["pam", "sshd"]
AUTH_SUCCESS = r"\b(accepted|opened|session opened)\b"
AUTH_FAIL = r"\b(failed|invalid|authentication failure|closed|rejected)\b"
FAIL_TERMS = ["fail", "invalid", "error", "denied", "refused", "incorrect", "bad", "not allowed"]
SUCCESS_TERMS = ["accept", "success", "granted", "opened", "authorized", "authenticated"]


def extract_ip(message: Column) -> Column:
    return first_group(message, IPV4)


def extract_user(message: Column) -> Column:
    """The first non-empty capture, in pattern order; every pattern runs once.

    (``nullif`` inside ``coalesce`` would run each of them twice, to test and to tell.)
    """
    found = F.array(*[F.regexp_extract(message, java_regex(p, True), 1) for p in USER_PATTERNS])
    return F.get(F.filter(found, lambda user: user != ""), F.lit(0))


def _holds_any(text: Column, terms: list[str]) -> Column:
    hit = F.contains(text, F.lit(terms[0]))
    for term in terms[1:]:
        hit = hit | F.contains(text, F.lit(term))
    return hit


def auth_status(message: Column, process: Column) -> Column:
    """SUCCESS, FAIL or INFO; login daemons are judged by whole words first."""
    low = F.lower(message)
    login = _holds_any(F.lower(process), AUTH_PROCESSES)
    return (
        F.when(login & low.rlike(java_regex(AUTH_SUCCESS)), "SUCCESS")
        .when(login & low.rlike(java_regex(AUTH_FAIL)), "FAIL")
        .when(_holds_any(low, FAIL_TERMS), "FAIL")
        .when(_holds_any(low, SUCCESS_TERMS), "SUCCESS")
        .otherwise("INFO")
    )


def _syslog_columns(group: Groups) -> dict[str, Column]:
    message = group(5)
    return {
        "timestamp": group(1),
        "hostname": group(2),
        "process": group(3),
        "pid": _or_null(group(4)),
        "ip_origen": extract_ip(message),
        "usuario": extract_user(message),
        "accion": message,
        "status": auth_status(message, group(3)),
    }


SYSLOG = LogFormat("syslog", (LineShape(SYSLOG_LINE, 5, _syslog_columns),))

# ---------------------------------------------------------------- web server

# Patterns of the access line, the error line and the parse-time tag.
ACCESS_LINE = (
    r"^(\d+\.\d+\.\d+\.\d+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"
    r'"(\S+)\s+(\S+)\s+[^"]*"\s+(\d+)\s+(\S+)\s+"([^"]*)"\s+"([^"]*)"'
)
ERROR_LINE = (
    r"^\[([^\]]+)\]\s+\[(\w+)\]\s+(?:\[pid\s+(\d+)\]\s+)?(?:\[client\s+([^\]]+)\]\s+)?(.*)$"
)
URL_TAGS = {"command_injection": r"(;|\||\`|\$\(|\$\{|&&|\|\||\n|%0a|%0d)"}


def http_status_class(code: Column) -> Column:
    number = code.try_cast("double")
    return F.when(number >= 400, "FAIL").when(number >= 200, "SUCCESS").otherwise("INFO")


def attack_tags(url: Column) -> Column:
    """Tags found in the raw URL, or null."""
    tags = F.array(
        *[
            F.when(url.rlike(java_regex(p, ignore_case=True)), F.lit(tag))
            for tag, p in URL_TAGS.items()
        ]
    )
    found = F.coalesce(*[tags[i] for i in range(len(URL_TAGS))])
    return F.when(found.isNotNull(), F.array_compact(tags))


def _access_columns(group: Groups) -> dict[str, Column]:
    url = group(6)
    return {
        "timestamp": normalize_timestamp(group(4)),
        "source_year": source_year(group(4)),
        "source_offset": source_offset(group(4)),
        "hostname": F.lit("-"),
        "process": F.lit("web_server"),
        "ip_origen": group(1),
        "usuario": F.nullif(group(3), F.lit("-")),
        "accion": F.concat_ws(" ", group(5), url),
        "status": http_status_class(group(7)),
        "method": group(5),
        "url": url,
        "http_status": group(7),
        "user_agent": group(10),
        "referer": group(9),
        "attack_types": attack_tags(url),
        "bytes_sent": group(8),
    }


def _error_columns(group: Groups) -> dict[str, Column]:
    return {
        "timestamp": normalize_timestamp(group(1)),
        "source_year": source_year(group(1)),
        "hostname": F.lit("-"),
        "process": F.lit("web_server"),
        "pid": _or_null(group(3)),
        "ip_origen": F.substring_index(_or_null(group(4)), ":", 1),
        "accion": group(5),
        "status": F.lit("FAIL"),
        "log_level": group(2),
    }


WEB = LogFormat(
    "web",
    (LineShape(ACCESS_LINE, 10, _access_columns), LineShape(ERROR_LINE, 5, _error_columns)),
)

# In order of preference: the first one wins a tie, and a file nobody knows.
FORMATS = (SYSLOG, WEB)
