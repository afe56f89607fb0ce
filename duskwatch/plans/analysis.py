"""The whole analysis: files in, events, alerts and statistics out."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from duskwatch import __version__
from duskwatch.operators.detect import Detector
from duskwatch.operators.normalize import normalize
from duskwatch.operators.rules import Rule, default_rules
from duskwatch.schema import EVENT_COLUMNS
from duskwatch.scratch import materialize
from duskwatch.sources.formats import FORMATS, LogFormat
from duskwatch.sources.text_logs import (
    cast_times,
    events_of,
    existing_paths,
    formats_of,
    raw_lines,
    read_lines,
    stats_of,
)


@dataclass(frozen=True)
class AnalysisResult:
    """Stored tables and lazy statistics over stored lines; nothing is collected."""

    events: DataFrame
    alerts: DataFrame
    stats: DataFrame
    metadata: dict = field(default_factory=dict)
    version: str = __version__

    @property
    def total_logs(self) -> int:
        return self.events.count()

    @property
    def total_anomalies(self) -> int:
        return self.alerts.count()


def analyze(
    spark: SparkSession,
    paths: str | Sequence[str],
    now: datetime | None = None,
    rules: Sequence[Rule] | None = None,
    model=None,
    formats: DataFrame | str | None = None,
    known: Sequence[LogFormat] = FORMATS,
    events_path: str | None = None,
    alerts_path: str | None = None,
    keep_source_year: bool = False,
) -> AnalysisResult:
    """Analyse log files with the default rules, ``rules`` and/or a trained model.

    The text is read once. All lines with what the formats make of them, then the
    normalised events (at ``events_path``) and the alerts (at ``alerts_path``) are
    written as parquet, by default to the session's shared scratch folder. Formats,
    statistics and rules read the columns they need from there, and alerts are not
    detected anew by every use. Paths that do not exist are named in
    ``metadata["missing_paths"]``; if none exists that is an error. ``keep_source_year``
    dates web logs by the year they state, not by ``now``, and keeps year and offset.
    """
    started = time.monotonic()
    found, missing = existing_paths(spark, paths)
    read = materialize(read_lines(raw_lines(spark, found if found else paths), known, keep_source_year))
    if formats is None:
        formats = materialize(formats_of(read, known))
    stamped = cast_times(events_of(read, formats), now or datetime.now())
    events = materialize(normalize(stamped), events_path)
    chosen = list(default_rules() if rules is None else rules)
    if model is not None:
        from duskwatch.operators.iforest import isolation_forest_rule

        chosen.append(isolation_forest_rule(model))
    detector = Detector(chosen)
    return AnalysisResult(
        events=events,
        alerts=detector.ordered(materialize(detector.alerts(events), alerts_path)),
        stats=stats_of(read, formats),
        metadata={
            "file_path": paths,
            "missing_paths": missing,
            "latency_ms": (time.monotonic() - started) * 1000,
            "rules_active": detector.active_rules,
            "extracted_fields": EVENT_COLUMNS,
        },
    )
