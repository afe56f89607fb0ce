"""Time windows counted by position, safe against hot keys.

All windows are per source address, end at the current row and count rows with the
same time only if they come earlier in the log. Four things keep any group small,
even if one address (the filled-in ``0.0.0.0``, say) holds a third of all rows:

* rows are pre-aggregated per (address, moment) before anything is ordered by time;
* trailing sums run per (address, slot), a slot being a stretch of time. The moments
  that the next slot still looks back on are copied into it;
* for marks, rows are ordered per (address, slot) as they are only if an address has less
  than a fair share of all rows in every slot: one exchange then does for all windows;
* ranks inside one moment are limited to the few that matter, or counted per run of
  ``2^RUN_BITS`` lines and then offset.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from duskwatch.functions.timestamps import epoch_micros
from duskwatch.schema import LINE_KEYS, RUN_BITS, line_key
from duskwatch.scratch import materialize

SOURCE = "ip_origen"
MOMENT = [SOURCE, "datetime"]
SLOT_SECONDS = 3600
MICROS = 1_000_000
# Rows of one address in one slot that a task orders: all rows divided by this, or so few.
FAIR_SHARES = 1000
SMALL_GROUP = 1 << 16
_KEY_TYPE = "struct<file_path:string,block:bigint,line_no:bigint>"


def timed_rows(df: DataFrame) -> DataFrame:
    """Rows that have an address and a time: others are in no window."""
    return df.where(F.col(SOURCE).isNotNull() & F.col("datetime").isNotNull())


def _slot_of(at: Column, seconds: int) -> Column:
    """The stretch of time that ``at`` is in, long enough for windows of ``seconds``."""
    width = max(SLOT_SECONDS, seconds) * MICROS
    return ((at - F.pmod(at, F.lit(width))) / width).cast("bigint")


def in_slots(df: DataFrame, seconds: int) -> DataFrame:
    """Add ``_at`` (microseconds), ``_slot`` and ``_home``.

    A row is copied to the following slot (``_home`` false) if a window of
    ``seconds`` that ends there can reach back to it.
    """
    width = max(SLOT_SECONDS, seconds) * MICROS
    at = F.col("_at")
    slot = _slot_of(at, seconds)
    reaches_on = F.pmod(at, F.lit(width)) >= width - seconds * MICROS
    placed = df.withColumn("_at", epoch_micros(F.col("datetime")))
    placed = placed.withColumn(
        "_slot", F.explode(F.when(reaches_on, F.array(slot, slot + 1)).otherwise(F.array(slot)))
    )
    return placed.withColumn("_home", F.col("_slot") == slot)


def _trailing_sum(df: DataFrame, amount: str, first: int, last: int) -> Column:
    frame = Window.partitionBy(SOURCE, "_slot").orderBy("_at").rangeBetween(first, last)
    return F.coalesce(F.sum(amount).over(frame), F.lit(0))


@dataclass(frozen=True)
class CountWindow:
    """Rows of ``predicate`` that are at least the ``limit``-th in [t - seconds, t]."""

    predicate: Callable[[DataFrame], Column]
    limit: int
    seconds: int


@dataclass(frozen=True)
class DistinctWindow:
    """Rows at which [t - seconds, t] holds at least ``limit`` different values so far."""

    value: str
    limit: int
    seconds: int


def burst_marks(df: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Where rows are at least the ``limit``-th in [t - seconds, t], both ends in.

    Result: (address, datetime, from_key), one row per moment with such rows. They
    are the moment's rows whose line key is ``from_key`` or later.
    """
    return _single(df, CountWindow(lambda _: F.lit(True), limit, seconds))


def distinct_marks(df: DataFrame, value: str, limit: int, seconds: int) -> DataFrame:
    """Where [t - seconds, t] holds at least ``limit`` different values so far.

    Same result form as :func:`burst_marks`.
    """
    return _single(df, DistinctWindow(value, limit, seconds))


def _single(df: DataFrame, window: CountWindow | DistinctWindow) -> DataFrame:
    return window_marks(df, [window]).select(*MOMENT, F.col("from0").alias("from_key"))


def window_marks(df: DataFrame, windows: Sequence[CountWindow | DistinctWindow]) -> DataFrame:
    """(address, datetime, from0, from1, ...): one row per moment that some window marks.

    ``from<i>`` belongs to the i-th window: the moment's rows (of its predicate) whose
    line key is ``from<i>`` or later are hit; null if none is. The events are looked at
    once, for the few columns that the windows need. Distinct windows must be over one
    column.

    Addresses are marked row by row in one exchange (:func:`_marks_in_order`), unless more
    rows of an hour come from one than a task should take: those shrink to moments before
    they are ordered (:func:`_marks_of_moments`). Both mark the same.
    """
    counts = {i: w for i, w in enumerate(windows) if isinstance(w, CountWindow)}
    distincts = {i: w for i, w in enumerate(windows) if isinstance(w, DistinctWindow)}
    values = list(dict.fromkeys(w.value for w in distincts.values()))
    if len(values) > 1:
        raise ValueError(f"Distinct windows over different columns are marked apart: {values}")
    needed = timed_rows(df).select(
        *MOMENT, *LINE_KEYS, *values, *[F.coalesce(c.predicate(df), F.lit(False)).alias(f"p{i}") for i, c in counts.items()]
    )
    if not values:
        needed = needed.where(reduce(Column.__or__, [F.col(f"p{i}") for i in counts]))
    rows = materialize(needed)
    hot = _hot_sources(rows, max(w.seconds for w in windows))
    if not hot:
        return _marks_in_order(rows, windows, counts, distincts, values)
    is_hot = F.col(SOURCE).isin(hot)
    return _marks_in_order(rows.where(~is_hot), windows, counts, distincts, values).unionByName(
        _marks_of_moments(rows.where(is_hot), windows, counts, distincts, values)
    )


def _hot_sources(rows: DataFrame, reach: int) -> list[str]:
    """Addresses with more than a fair share of all rows in a slot: fewer than ``FAIR_SHARES``."""
    at = epoch_micros(F.col("datetime"))
    slots = rows.groupBy(SOURCE, _slot_of(at, reach).alias("_slot")).agg(F.count(F.lit(1)).alias("_rows"))
    share = max(SMALL_GROUP, -(-rows.count() // FAIR_SHARES))
    return [r[0] for r in slots.where(F.col("_rows") > share).select(SOURCE).distinct().collect()]


def _marks_in_order(
    rows: DataFrame,
    windows: Sequence[CountWindow | DistinctWindow],
    counts: dict[int, CountWindow],
    distincts: dict[int, DistinctWindow],
    values: list[str],
) -> DataFrame:
    """The marks by one exchange per (address, slot) and the rows in order.

    What is in a window at a row is what has come so far less what the window has passed.
    Rows of a predicate come and pass; a value comes with a row that has not seen it
    within the window, and passes with its last row before it is missed that long.
    """
    at = F.col("_at")
    slot, placed = _by_slot(rows, max(w.seconds for w in windows))
    comes = {i: F.col(f"p{i}") for i in counts}
    passes = dict(comes)
    if distincts:
        steps = Window.partitionBy(*slot, *values).orderBy("_at", *LINE_KEYS)
        placed = placed.withColumns({"_gap": at - F.lag("_at").over(steps), "_next": F.lead("_at").over(steps) - at})
        for i, w in distincts.items():
            comes[i], passes[i] = (F.coalesce(F.col(c) > w.seconds * MICROS, F.lit(True)) for c in ("_gap", "_next"))
    placed = placed.withColumns({f"_come{i}": F.sum(c.cast("int")).over(_so_far(slot)) for i, c in comes.items()})
    placed = placed.withColumns(
        {f"_gone{i}": F.sum(c.cast("int")).over(_passed(slot, windows[i].seconds * MICROS + 1)) for i, c in passes.items()}
    )
    hit = {i: F.col(f"_come{i}") - F.coalesce(f"_gone{i}", F.lit(0)) >= w.limit for i, w in enumerate(windows)}
    hit |= {i: F.col(f"p{i}") & hit[i] for i in counts}
    hits = placed.select(*slot, "_at", "_home", "datetime", line_key().alias("_key"), *[hit[i].alias(f"_hit{i}") for i in hit])
    hits = hits.where(F.col("_home") & reduce(Column.__or__, [F.col(f"_hit{i}") for i in hit]))
    first = [F.min(F.when(F.col(f"_hit{i}"), F.col("_key"))).alias(f"from{i}") for i in range(len(windows))]
    return hits.groupBy(*slot, "_at").agg(F.max("datetime").alias("datetime"), *first).select(
        *MOMENT, *[f"from{i}" for i in range(len(windows))]
    )


def _by_slot(rows: DataFrame, reach: int) -> tuple[list[str], DataFrame]:
    """Rows dealt by (address, slot), and the columns to group them by."""
    placed = in_slots(rows, reach).repartition(SOURCE, "_slot")
    # Sorts compare the hash first: the texts of addresses begin alike.
    return ["_group", SOURCE, "_slot"], placed.withColumn("_group", F.xxhash64(SOURCE, "_slot"))


def _so_far(slot: list[str]) -> WindowSpec:
    return Window.partitionBy(*slot).orderBy("_at", *LINE_KEYS).rowsBetween(Window.unboundedPreceding, 0)


def _passed(slot: list[str], micros: int) -> WindowSpec:
    """Rows at least ``micros`` before: the frame only grows, so each row is summed once."""
    return Window.partitionBy(*slot).orderBy("_at").rangeBetween(Window.unboundedPreceding, -micros)


def _visits(rows: DataFrame, counts: dict[int, CountWindow], values: list[str]) -> DataFrame:
    """(moment, values, p<i>, keys): rows alike in a moment, with the first few line keys of them.

    Count windows need the first ``limit`` rows of a moment and distinct windows the first
    of each value: both are limited map-side.
    """
    alike = [*MOMENT, *values, *[f"p{i}" for i in counts]]
    if not counts:
        return rows.groupBy(*alike).agg(F.array(F.min(line_key())).alias("keys"))
    order = Window.partitionBy(*alike).orderBy(*LINE_KEYS)
    most = max(c.limit for c in counts.values())
    firsts = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return firsts.groupBy(*alike).agg(F.sort_array(F.collect_list(line_key())).alias("keys"))


def _marks_of_moments(
    rows: DataFrame,
    windows: Sequence[CountWindow | DistinctWindow],
    counts: dict[int, CountWindow],
    distincts: dict[int, DistinctWindow],
    values: list[str],
) -> DataFrame:
    """The marks of addresses of any number of rows: all windows start from one stored
    aggregate of the rows and share the sums per (address, slot).

    A count window sums the rows of earlier moments and finds the row of the moment that
    reaches the limit. For a distinct window each (address, value) is turned into
    stretches of time in which it is present; a running sum over their ends gives the
    number of values seen before a moment, and values new in the moment are added in
    line order.
    """
    reach = max(w.seconds for w in windows)
    # Written once: the keys of a moment and the stretches of time both start from it.
    visits = materialize(_visits(rows, counts, values))
    at = F.col("_at")
    first = F.get("keys", F.lit(0))
    seen = in_slots(visits, reach)
    if distincts:
        steps = Window.partitionBy(SOURCE, "_slot", *values).orderBy("_at", first)
        seen = materialize(
            seen.withColumns({"_gap": at - F.lag("_at").over(steps), "_next": F.lead("_at").over(steps) - at}).drop(*values)
        )

    def new(w: DistinctWindow) -> Column:
        return F.coalesce(F.col("_gap") > w.seconds * MICROS, F.lit(True))

    def left(w: DistinctWindow) -> Column:
        return F.coalesce(F.col("_next") > w.seconds * MICROS, F.lit(True))

    def keyed(i: int, keys: Column, when: Column) -> Column:
        none = F.array().cast(f"array<struct<window:int,key:{_KEY_TYPE}>>")
        named = F.transform(keys, lambda k: F.struct(F.lit(i).alias("window"), k.alias("key")))
        return F.when(when, named).otherwise(none)

    # The first keys of each moment for each window: few, and limited map-side too.
    told = F.concat(
        *[keyed(i, F.col("keys"), F.col(f"p{i}")) for i in counts],
        *[keyed(i, F.array(first), new(w)) for i, w in distincts.items()],
    )
    order = Window.partitionBy(*MOMENT, "window").orderBy("key")
    most = max(w.limit for w in windows)
    lists = (
        seen.where("_home").select(*MOMENT, F.inline(told))
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= most)
        .groupBy(*MOMENT, "window")
        .agg(F.sort_array(F.collect_list("key")).alias("list"))
    )
    changes = {f"by{i}": F.lit(0) for i in distincts}
    listed = in_slots(lists, reach).select(
        SOURCE, "_slot", "_at", F.when(F.col("_home"), F.col("datetime")).alias("datetime"),
        F.lit(None).cast(_KEY_TYPE).alias("start"),
        *[F.when(F.col("window") == i, F.col("list")).alias(f"list{i}") for i in range(len(windows))],
        *[c.alias(n) for n, c in changes.items()],
    )
    if distincts:
        listed = listed.unionByName(_changes(seen, distincts, new, left, first), allowMissingColumns=True)
    moments = listed.groupBy(SOURCE, "_slot", "_at").agg(
        F.max("datetime").alias("datetime"), F.min("start").alias("start"),
        *[F.max(f"list{i}").alias(f"list{i}") for i in range(len(windows))],
        *[F.sum(n).alias(n) for n in changes],
    )
    summed = moments.withColumns({f"_rows{i}": F.greatest(F.size(f"list{i}"), F.lit(0)) for i in counts})
    running = Window.partitionBy(SOURCE, "_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = {f"_before{i}": _trailing_sum(summed, f"_rows{i}", -w.seconds * MICROS, -1) for i, w in counts.items()}
    before |= {f"_before{i}": F.sum(f"by{i}").over(running) for i in distincts}
    marks = {}
    for i, w in enumerate(windows):
        needed = (F.lit(w.limit) - F.col(f"_before{i}")).cast("int")
        if i in counts:
            marks[f"from{i}"] = F.get(f"list{i}", F.greatest(needed, F.lit(1)) - 1)
        else:
            # the moment's row that brings the last value still needed
            marks[f"from{i}"] = F.when(needed <= 0, F.col("start")).otherwise(F.get(f"list{i}", needed - 1))
    found = summed.withColumns(before).where("datetime is not null").select(
        *MOMENT, *[m.alias(n) for n, m in marks.items()]
    )
    return found.where(F.coalesce(*marks).isNotNull())


def _changes(seen: DataFrame, distincts: dict[int, DistinctWindow], new, left, first: Column) -> DataFrame:
    """When values come and go: present from just after a visit until the window has left it behind."""
    at = F.col("_at")

    def change(when: Column, i: int | None, by: int, visit: bool) -> Column:
        home = F.lit(visit) & F.col("_home")
        return F.struct(
            when.alias("at"),
            *[F.lit(by if i == j else 0).alias(f"by{j}") for j in distincts],
            F.when(home, F.col("datetime")).alias("datetime"), F.when(home, first).alias("start"),
        )

    changes = [change(at, None, 0, True)]
    for i, w in distincts.items():
        changes.append(F.when(new(w), change(at + 1, i, 1, False)))
        changes.append(F.when(left(w), change(at + w.seconds * MICROS + 1, i, -1, False)))
    spread = seen.select(SOURCE, "_slot", F.explode(F.array_compact(F.array(*changes))).alias("c"))
    return spread.select(SOURCE, "_slot", F.col("c.at").alias("_at"), "c.datetime", "c.start", *[f"c.by{j}" for j in distincts])


def marked(from_key: Column) -> Column:
    """Is the row one of those a mark of its moment stands for?"""
    return line_key() >= from_key


def trailing_counts(df: DataFrame, seconds: int, name: str) -> DataFrame:
    """Add the number of rows in (t - seconds, t], left end open, by position.

    As for marks, rows are counted in order unless an address has too many in an hour.
    ``df`` is read more than once.
    """
    rows = timed_rows(df)
    hot = _hot_sources(rows, seconds)
    if not hot:
        return _counted_in_order(rows, seconds, name)
    is_hot = F.col(SOURCE).isin(hot)
    return _counted_in_order(rows.where(~is_hot), seconds, name).unionByName(
        _counted_by_moments(rows.where(is_hot), seconds, name)
    )


def _counted_in_order(rows: DataFrame, seconds: int, name: str) -> DataFrame:
    slot, placed = _by_slot(rows, seconds)
    one = F.lit(1)
    placed = placed.withColumn("_come", F.count(one).over(_so_far(slot)))
    placed = placed.withColumn("_gone", F.count(one).over(_passed(slot, seconds * MICROS)))
    return placed.where("_home").select(*rows.columns, (F.col("_come") - F.col("_gone")).alias(name))


def _counted_by_moments(rows: DataFrame, seconds: int, name: str) -> DataFrame:
    """The same for addresses of any number of rows: moments are summed, runs of lines ranked."""
    run = F.shiftright("line_no", RUN_BITS)
    cell = [*MOMENT, "file_path", "block", "_run"]
    placed = rows.withColumn("_run", run)
    # Written once: the moments are summed from it, and the offsets are added to it.
    cells = materialize(placed.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows")))
    moments = cells.groupBy(*MOMENT).agg(F.sum("_rows").alias("_all"))
    before = _trailing_sum(moments, "_all", -seconds * MICROS + 1, -1)
    moments = in_slots(moments, seconds).withColumn("_before", before).where("_home")
    earlier = Window.partitionBy(*MOMENT).orderBy("file_path", "block", "_run")
    cells = cells.withColumn(
        "_earlier",
        F.sum("_rows").over(earlier.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows"),
    )
    offsets = cells.join(moments.select(*MOMENT, "_before"), MOMENT).select(
        *cell, (F.col("_before") + F.col("_earlier")).alias("_offset")
    )
    place = F.row_number().over(Window.partitionBy(*cell).orderBy("line_no"))
    return placed.withColumn("_place", place).join(offsets, cell).select(
        *rows.columns, (F.col("_offset") + F.col("_place")).alias(name)
    )
