"""Detection rules: row predicates, window marks and rules of any other form.

Every rule is data plus a DataFrame expression. ``evaluate`` returns the rows it
finds suspicious with ``reason``, ``rule`` and ``severity``; a table that lacks a
column the rule needs gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.regex import any_of
from duskwatch.schema import with_line_keys

from .windows import MOMENT, CountWindow, DistinctWindow, marked, window_marks

# Severity by rank.
SEVERITY_RANK = {"high": 3, "medium": 2, "low": 1}


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    needs: tuple[str, ...]

    def applies_to(self, df: DataFrame) -> bool:
        return all(c in df.columns for c in self.needs)

    def found(self, df: DataFrame) -> DataFrame:
        """The suspicious rows with ``reason``."""
        raise NotImplementedError

    def evaluate(self, df: DataFrame) -> DataFrame:
        if self.applies_to(df):
            rows = self.found(df)
        else:
            rows = df.limit(0).withColumn("reason", F.lit(None).cast("string"))
        return rows.withColumns({"rule": F.lit(self.name), "severity": F.lit(self.severity)})


@dataclass(frozen=True)
class RowRule(Rule):
    """Judges a row by itself: a filter, evaluated inside the scan stage."""

    predicate: Callable[[DataFrame], Column]
    reason: str | Callable[[], Column]

    def reason_column(self) -> Column:
        return F.lit(self.reason) if isinstance(self.reason, str) else self.reason()

    def found(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate(df)).withColumn("reason", self.reason_column())


@dataclass(frozen=True)
class WindowRule(Rule):
    """Judges a row by what came before it from the same source.

    ``marks`` gives (ip_origen, datetime, from_key), ``eligible`` the rows that can
    be hit; see :mod:`duskwatch.operators.windows`. A :class:`CountWindow` or
    :class:`DistinctWindow` in place of the function is marked together with those of
    the other rules.
    """

    marks: Callable[[DataFrame], DataFrame] | CountWindow | DistinctWindow
    eligible: Callable[[DataFrame], Column]
    reason: str

    def marks_in(self, df: DataFrame) -> DataFrame:
        if isinstance(self.marks, (CountWindow, DistinctWindow)):
            return window_marks(df, [self.marks]).withColumnRenamed("from0", "from_key")
        return self.marks(df)

    def found(self, df: DataFrame) -> DataFrame:
        keyed = with_line_keys(df)
        rows = keyed.where(self.eligible(df)).join(self.marks_in(keyed), MOMENT)
        return rows.where(marked(F.col("from_key"))).select(
            *[F.col(c) for c in df.columns], F.lit(self.reason).alias("reason")
        )


@dataclass(frozen=True)
class FrameRule(Rule):
    """Any function from events to the suspicious ones among them."""

    rows: Callable[[DataFrame], DataFrame]
    reason: str

    def found(self, df: DataFrame) -> DataFrame:
        return self.rows(df).select(*df.columns, F.lit(self.reason).alias("reason"))


# ---------------------------------------------------------------- window rules


def brute_force(limit: int = 6, seconds: int = 60) -> WindowRule:
    def failed(df: DataFrame) -> Column:
        return F.col("status") == "FAIL"

    return WindowRule(
        "Brute Force",
        "high",
        ("datetime", "ip_origen", "status"),
        marks=CountWindow(failed, limit, seconds),
        eligible=failed,
        reason=f"Brute Force: Threshold reached ({limit}+ failed logins)",
    )


def user_probing(limit: int = 4, seconds: int = 600) -> WindowRule:
    return WindowRule(
        "User Probing",
        "high",
        ("datetime", "ip_origen", "usuario"),
        marks=DistinctWindow("usuario", limit, seconds),
        eligible=lambda df: F.lit(True),
        reason=f"User Probing: Threshold reached ({limit}+ unique users in {seconds // 60}min)",
    )


# ------------------------------------------------------------------- row rules

# The names, severities and reasons of all rules, as reports show them, and attack patterns per rule, matched without regard to case.
SQL_PATTERNS = [
    r"('|\")\s*(or|and|union|select|--|#|;)",
    r"=\s*[^&\n]*('|\")\s*(--|;|or\b|and\b)",
    r"union\s+(?:all\s+)?select\s+.+\s+from",
    r"insert\s+into\s+\w+\s*\(",
    r"delete\s+from\s+\w+\s+where",
    r"update\s+\w+\s+set\s+\w+\s*=",
    r"drop\s+(table|database)\s+\w+",
    r"exec\s*\(\s*|xp_\w+",
    r"benchmark\s*\(\s*\d+",
    r"\bsleep\s*\(\s*\d+",
    r";\s*(select|insert|update|delete|drop|exec)\b",
]
XSS_PATTERNS = [
    r"<script[^>]*>[\s\S]*?</script>",
    r"javascript:",
    r"on\w+\s*=\s*['\"]",
    r"alert\s*\(",
    r"document\.cookie",
    r"document\.location",
    r"window\.location",
    r"eval\s*\(",
    r"String\.fromCharCode",
    r"<iframe",
    r"<object",
    r"<embed",
    r"expression\s*\(",
]
TRAVERSAL_PATTERNS = [
    r"\.\./",
    r"\.\.[/\\]",
    r"\.\.%2f",
    r"\.\.\.\.\/",
    r"etc/passwd",
    r"windows/win\.ini",
    r"boot\.ini",
    r"\.\.%c0%af",
    r"\.\.%c1%9c",
]
# What a match of any of these can begin with.
SQL_STARTS = "['\"=;bdeisux]"
XSS_STARTS = "[<adejosw]"
TRAVERSAL_STARTS = "[.bew]"


def time_anomaly(start_hour: int = 8, end_hour: int = 18) -> RowRule:
    def off_hours(df: DataFrame) -> Column:
        hour = F.hour("datetime")
        return (F.col("status") == "SUCCESS") & ((hour < start_hour) | (hour >= end_hour))

    return RowRule(
        "Time Anomaly",
        "medium",
        ("datetime", "status"),
        predicate=off_hours,
        reason="Time Anomaly: Login outside business hours",
    )


def _found_in(columns: list[str], patterns: list[str], starts: str) -> Callable[[DataFrame], Column]:
    regex = any_of(patterns, starts)

    def predicate(df: DataFrame) -> Column:
        hit = F.lit(False)
        for name in columns:
            if name == "url" and "url_decoded" in df.columns:
                name = "url_decoded"
            if name in df.columns:
                hit = hit | F.coalesce(F.col(name).rlike(regex), F.lit(False))
        return hit

    return predicate


def sql_injection() -> RowRule:
    return RowRule(
        "SQL Injection",
        "high",
        ("url",),
        predicate=_found_in(["url"], SQL_PATTERNS, SQL_STARTS),
        reason="Detected by SQL Injection",
    )


def xss_attack() -> RowRule:
    return RowRule(
        "XSS Attack",
        "medium",
        ("url",),
        predicate=_found_in(["url", "user_agent"], XSS_PATTERNS, XSS_STARTS),
        reason="Detected by XSS Attack",
    )


def path_traversal() -> RowRule:
    return RowRule(
        "Path Traversal",
        "high",
        ("url",),
        predicate=_found_in(["url"], TRAVERSAL_PATTERNS, TRAVERSAL_STARTS),
        reason="Detected by Path Traversal",
    )


def web_attack() -> RowRule:
    return RowRule(
        "Web Attack",
        "medium",
        ("attack_types",),
        predicate=lambda df: F.col("attack_types").isNotNull(),
        reason=lambda: F.concat(F.lit("Detected by Web Attack: "), F.array_join("attack_types", ", ")),
    )


def default_rules() -> list[Rule]:
    """The standard rules, in the order their findings are listed."""
    return [
        brute_force(),
        time_anomaly(),
        user_probing(),
        sql_injection(),
        xss_attack(),
        path_traversal(),
        web_attack(),
    ]
