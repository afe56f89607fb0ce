"""Log lines made from the ``events`` table, the same texts the oracle SQL makes.

Users share an address in groups of six, times are packed by a factor so that the
window rules find something, and every 97th line is one no format accepts.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.operators.normalize import normalize
from duskwatch.sources.text_logs import cast_times, log_lines, parse_lines

NOW = datetime(2024, 12, 31, 23, 59, 59)
MID_JANUARY = datetime(2024, 1, 15)

# Packing factors: brute force needs dense failures, the other rules do not.
DENSE, MEDIUM, PLAIN = 1200, 30, 1

# Sixteen: attacks, some of them escaped, and texts that only look like some.
URLS = [
    "/tea/green.html",
    "/stock?shelf=9' uNiOn sElEcT code, price fRoM parts",
    "/stock?shelf=%22%20OR%20%22a%22%3D%22a",
    "/note?t=<script>eval(1)</script>",
    "/note?t=%3Ciframe%20src%3Dx%3E",
    "/files/../../k/etc/passwd",
    "/files?f=%2E%2e%2fboot.ini",
    "/guests/kim's-table",
    "/manual#part-7",
    "/do?job=zip;tail",
    "/works/selected-songs?tone=low+soft",
    "/go?to=JavaScript:eval(2)",
    "/caf%C3%A9/na%C3%AFve?x=100%&y=%zz",
    "/b?n=3;DROP TABLE parts",
    "/door",
    "/echo?to=b%0Awho|wc",
]
AGENTS = [
    "Mozilla/5.0",
    "curl/8.1",
    "<script>window.location</script>",
    "-",
    "Bot (compatible)",
    "Mozilla/5.0 onload='x'",
    "",
]
STATUS = {"error": "500", "signup": "200", "click": "302", "view": "404", "purchase": "100"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A small table is one file and one task; the lines made of it cost more than it.
    return spark.read.parquet(f"{sf_dir}/events.parquet").repartition(
        spark.sparkContext.defaultParallelism
    )


def _moment(pack: int) -> Column:
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz"))
    seconds = F.floor(micros / F.lit(1_000_000 * pack)).cast("bigint")
    return F.timestamp_add("SECOND", seconds, start)


def _ip() -> Column:
    group = F.floor(F.col("user_id") / 6).cast("bigint")
    return F.concat(
        F.lit("10.0."),
        F.floor(group / 250).cast("bigint").cast("string"),
        F.lit("."),
        (group % 250).cast("string"),
    )


def _user() -> Column:
    return F.concat(F.lit("u"), F.col("user_id").cast("string"))


def _garbage() -> Column:
    return F.col("event_id") % 97 == 0


def _lines(df: DataFrame, prefix: str, text: Column) -> DataFrame:
    files = F.concat(F.lit(prefix), (F.col("event_id") % 4).cast("string"), F.lit(".log"))
    return df.select(
        files.alias("file_path"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("event_id").alias("line_no"),
        F.when(_garbage(), F.lit("-- no known format --")).otherwise(text).alias("value"),
    )


def syslog_lines(spark: SparkSession, sf_dir: str, pack: int) -> DataFrame:
    user, ip = _user(), _ip()
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", F.concat(F.lit("Failed password for "), user, F.lit(" from "), ip))
        .when(kind == "signup", F.concat(F.lit("Accepted password for "), user, F.lit(" from "), ip))
        .when(kind == "click", F.concat(F.lit("session opened for user "), user, F.lit(" from "), ip))
        .when(
            kind == "view",
            F.concat(F.lit("Failed password for invalid user "), user, F.lit(" from "), ip),
        )
        .otherwise("connection reset by peer")
    )
    text = F.concat(
        F.date_format(_moment(pack), "MMM dd HH:mm:ss"),
        F.lit(" host"),
        (F.col("user_id") % 3).cast("string"),
        F.when(kind == "purchase", F.lit(" kernel: ")).otherwise(
            F.concat(F.lit(" sshd["), (F.col("event_id") % 9000 + 100).cast("string"), F.lit("]: "))
        ),
        message,
    )
    return _lines(events(spark, sf_dir), "auth-", text)


def _choice(texts: list[str], column: str) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col(column) % len(texts) + 1).cast("int"))


def access_lines(spark: SparkSession, sf_dir: str, pack: int) -> DataFrame:
    code = F
    for kind, value in STATUS.items():
        code = code.when(F.col("event_type") == kind, value)
    # A URL in a log line holds no blank: they are written as '+'.
    url = F.replace(_choice(URLS, "event_id"), F.lit(" "), F.lit("+"))
    text = F.concat(
        _ip(),
        F.lit(" - "),
        F.when(F.col("event_type") == "view", F.lit("-")).otherwise(_user()),
        F.lit(" ["),
        F.date_format(_moment(pack), "dd/MMM/yyyy:HH:mm:ss"),
        F.lit(' +0200] "'),
        F.when(F.col("event_id") % 5 == 0, F.lit("POST ")).otherwise("GET "),
        url,
        F.lit(' HTTP/1.1" '),
        code,
        F.lit(" "),
        F.when(F.col("event_id") % 11 == 0, F.lit("-")).otherwise(
            (F.col("event_id") % 5000).cast("string")
        ),
        F.lit(' "https://example.com/p'),
        (F.col("event_id") % 3).cast("string"),
        F.lit('" "'),
        _choice(AGENTS, "event_id"),
        F.lit('"'),
    )
    return _lines(events(spark, sf_dir), "access-", text)


def error_lines(spark: SparkSession, sf_dir: str, pack: int) -> DataFrame:
    moment = _moment(pack)
    text = F.concat(
        F.lit("["),
        F.date_format(moment, "EEE MMM dd HH:mm:ss"),
        F.when(F.col("event_id") % 2 == 0, F.lit(".123456")).otherwise(""),
        F.lit(" 2024] [error] "),
        F.when(
            F.col("event_id") % 3 == 0,
            F.concat(F.lit("[pid "), (F.col("event_id") % 777).cast("string"), F.lit("] ")),
        ).otherwise(""),
        F.when(
            F.col("event_id") % 5 != 0, F.concat(F.lit("[client "), _ip(), F.lit(":4711] "))
        ).otherwise(""),
        F.lit("File does not exist: /var/www/"),
        F.col("event_type"),
    )
    return _lines(events(spark, sf_dir), "error-", text)


def syslog_events(spark: SparkSession, sf_dir: str, pack: int, now: datetime = NOW) -> DataFrame:
    lines = log_lines(syslog_lines(spark, sf_dir, pack))
    return cast_times(parse_lines(lines, "syslog"), now)


def web_events(spark: SparkSession, sf_dir: str, pack: int, now: datetime = NOW) -> DataFrame:
    both = access_lines(spark, sf_dir, pack).unionByName(error_lines(spark, sf_dir, pack))
    return cast_times(parse_lines(log_lines(both), "web"), now)


def all_events(spark: SparkSession, sf_dir: str, pack: int) -> DataFrame:
    """System and web events of the same users, normalised."""
    return normalize(
        syslog_events(spark, sf_dir, pack).unionByName(web_events(spark, sf_dir, pack))
    )
