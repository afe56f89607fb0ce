"""Running a set of rules over an event table and merging what they find."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.schema import LINE_KEYS, line_key, with_line_keys
from duskwatch.scratch import materialize

from .rules import SEVERITY_RANK, FrameRule, RowRule, Rule, WindowRule, default_rules
from .windows import MOMENT, CountWindow, DistinctWindow, marked, window_marks

# What makes two findings the same alert; nulls are values like any other.
ALERT_KEYS = ["datetime", "ip_origen", "usuario", "accion", "status"]
JOINER = " | "
# Rules per word of the bit mask of findings.
WORD_BITS = 63
# Words of 64 bits in the table of marked moments that every task gets: 16 MB of numbers.
MARK_WORDS = 1 << 20


class Detector:
    """An ordered set of rules. A second rule of the same name is ignored."""

    def __init__(self, rules: Iterable[Rule] | None = None):
        self.rules: list[Rule] = []
        for rule in default_rules() if rules is None else rules:
            self.add_rule(rule)

    def add_rule(self, rule: Rule) -> None:
        if all(rule.name != r.name for r in self.rules):
            self.rules.append(rule)

    @property
    def active_rules(self) -> list[str]:
        return [r.name for r in self.rules]

    def hits(self, events: DataFrame) -> DataFrame:
        """Findings, not merged yet: alert keys, line keys, ``found0``, ... and ``texts``.

        Bit i of ``found0`` stands for the i-th rule, ``found1`` has the next 63 and so
        on; ``texts`` holds (ord, reason) of
        rules whose reason depends on the row. All row rules are judged in one pass
        that shuffles nothing. The marks of all window rules are joined to the events
        in a second pass, so an event hit by both kinds appears twice here.
        """
        df = with_line_keys(events)
        numbered = [(i, r) for i, r in enumerate(self.rules) if r.applies_to(df)]
        keep = [c for c in [*ALERT_KEYS, "timestamp"] if c in df.columns] + LINE_KEYS

        def of_kind(kind: type) -> list[tuple[int, Rule]]:
            return [(i, r) for i, r in numbered if isinstance(r, kind)]

        words = self._words
        parts = []
        if of_kind(RowRule):
            parts.append(_row_hits(df, keep, words, of_kind(RowRule)))
        if of_kind(WindowRule):
            parts.append(_window_hits(df, keep, words, of_kind(WindowRule)))
        for i, rule in of_kind(FrameRule):
            bits = [_bit(i, w).alias(name) for w, name in enumerate(words)]
            parts.append(rule.rows(df).select(*keep, *bits, _no_texts()))
        if not parts:
            parts.append(df.limit(0).select(*keep, *[_none().alias(w) for w in words], _no_texts()))
        return reduce(DataFrame.unionByName, parts)

    @property
    def _words(self) -> list[str]:
        return [f"found{w}" for w in range(max(1, -(-len(self.rules) // WORD_BITS)))]

    def findings(self, events: DataFrame) -> DataFrame:
        """One row per event and rule that hits it: line keys, alert keys, ``ord``, rule, reason, severity."""
        hits = self.hits(events)
        told = [
            F.when(
                _has(i, "found"),
                F.struct(
                    F.lit(i).alias("ord"), F.lit(r.name).alias("rule"),
                    (F.lit(r.reason) if isinstance(r.reason, str) else _texts_of(i, "texts")[0]).alias("reason"),
                    F.lit(r.severity).alias("severity"),
                ),
            )
            for i, r in enumerate(self.rules)
        ]
        keys = [c for c in ALERT_KEYS if c in hits.columns]
        if not told:
            told = [F.lit(None).cast("struct<ord:int,rule:string,reason:string,severity:string>")]
        return hits.select(*LINE_KEYS, *keys, F.explode(F.array_compact(F.array(*told))).alias("_told")).select(
            *LINE_KEYS, *keys, "_told.*"
        )

    def alerts(self, events: DataFrame) -> DataFrame:
        """One row per alert: keys, reason, rule, severity, timestamp; not sorted."""
        hits = self.hits(events)
        keys = [c for c in ALERT_KEYS if c in hits.columns]
        masks = [F.bit_or(w).alias(w) for w in self._words]
        stamped = "timestamp" in hits.columns
        if stamped:
            # the lowest bit is the first rule of a row
            lowest = [F.nullif(F.col(w).bitwiseAND(-F.col(w)), F.lit(0)) for w in self._words]
            place = F.struct(*[F.coalesce(b, F.lit(2**63 - 1)) for b in lowest], line_key())
            told = F.when(F.col("timestamp").isNotNull(), F.struct(place.alias("place"), F.col("timestamp")))
            hits = hits.withColumn("_told", told)
            masks.append(F.min("_told").alias("_told"))
        # Repeated findings shrink to one row per task before they are shuffled.
        if any(not isinstance(r.reason, str) for r in self.rules):
            # Equal texts first, each with the first line that says so.
            said = F.when(F.col("texts").isNotNull(), line_key()).alias("_line")
            hits = hits.withColumn("_line", said).groupBy(*keys, "texts").agg(*masks, F.min("_line").alias("_line"))
            lines = F.transform("texts", lambda t: F.struct(t["ord"].alias("ord"), F.col("_line").alias("line"), t["reason"].alias("reason")))
            hits = hits.withColumn("_said", lines)
        else:
            hits = hits.withColumn("_said", F.lit(None).cast(_SAID))
        merged = hits.groupBy(*keys).agg(
            *masks, F.array_sort(F.flatten(F.collect_list("_said"))).alias("_texts")
        ).withColumnsRenamed({w: f"_{w}" for w in self._words})
        if stamped:
            merged = merged.withColumn("timestamp", F.col("_told")["timestamp"])
        return merged.select(
            *keys,
            self._reasons().alias("reason"),
            F.array_join(F.array(*[_if_found(i, r.name) for i, r in enumerate(self.rules)]), JOINER).alias("rule"),
            self._severity().alias("severity"),
            *[c for c in merged.columns if c == "timestamp"],
        )

    def _reasons(self) -> Column:
        """Different reasons in rule order, those of one rule in order of the first line that has them."""
        parts = [F.array().cast("array<string>")]
        for i, rule in enumerate(self.rules):
            reason = rule.reason
            if isinstance(reason, str):
                parts.append(F.array_compact(F.array(_if_found(i, reason))))
            else:
                parts.append(_texts_of(i))
        return F.array_join(F.array_distinct(F.flatten(F.array(*parts))), JOINER)

    def _severity(self) -> Column:
        ranked = sorted(
            enumerate(self.rules), key=lambda p: -SEVERITY_RANK.get(p[1].severity.lower(), 0)
        )
        return F.coalesce(*[_if_found(i, r.severity) for i, r in ranked], F.lit(None).cast("string"))

    def run(self, events: DataFrame) -> DataFrame:
        """Alerts in order of time; rows of one moment in order of their keys.

        They are written once: finding the ranges of a sort takes a pass over them.
        """
        return self.ordered(materialize(self.alerts(events)))

    @staticmethod
    def ordered(alerts: DataFrame) -> DataFrame:
        keys = [c for c in ALERT_KEYS if c in alerts.columns]
        return alerts.orderBy(*keys)


_SAID = "array<struct<ord:int,line:struct<file_path:string,block:bigint,line_no:bigint>,reason:string>>"


def _none() -> Column:
    return F.lit(0).cast("bigint")


def _bit(i: int, word: int) -> Column:
    """What the i-th rule adds to a word of the mask."""
    return F.lit(1 << i % WORD_BITS if i // WORD_BITS == word else 0).cast("bigint")


def _has(i: int, prefix: str) -> Column:
    word = i // WORD_BITS
    return F.col(f"{prefix}{word}").bitwiseAND(_bit(i, word)) != 0


def _if_found(i: int, text: str) -> Column:
    return F.when(_has(i, "_found"), F.lit(text))


def _texts_of(i: int, texts: str = "_texts") -> Column:
    mine = F.filter(texts, lambda t: t["ord"] == i)
    return F.transform(mine, lambda t: t["reason"])


def _no_texts() -> Column:
    return F.lit(None).cast("array<struct<ord:int,reason:string>>").alias("texts")


def _row_hits(df: DataFrame, keep: list[str], words: list[str], rules: list[tuple[int, RowRule]]) -> DataFrame:
    found = [_none() for _ in words]
    for i, r in rules:
        word = i // WORD_BITS
        found[word] = found[word].bitwiseOR(F.when(r.predicate(df), _bit(i, word)).otherwise(_none()))
    varying = [(i, r) for i, r in rules if not isinstance(r.reason, str)]
    texts = _no_texts()
    if varying:
        told = [
            F.when(_has(i, "found"), F.struct(F.lit(i).alias("ord"), r.reason_column().alias("reason")))
            for i, r in varying
        ]
        texts = F.when(F.coalesce(*told).isNotNull(), F.array_compact(F.array(*told))).alias("texts")
    # Behind explode() neither the filter nor the texts repeat the patterns.
    named = F.struct(*[f.alias(w) for f, w in zip(found, words)])
    judged = df.select("*", F.explode(F.array(named)).alias("_found")).select("*", "_found.*")
    any_hit = reduce(Column.__or__, [F.col(w) != 0 for w in words])
    return judged.where(any_hit).select(*keep, *words, texts)


def _merged_marks(df: DataFrame, rules: list[tuple[int, WindowRule]]) -> DataFrame:
    """(moment, _from<i>, ...): the marks of all rules, one row per moment.

    Count and distinct windows share one aggregate of the events; distinct windows over
    other columns and rules with marks of their own are marked apart and merged.
    """
    together: dict[str | None, list[tuple[int, WindowRule]]] = {}
    apart = []
    for i, r in rules:
        if isinstance(r.marks, DistinctWindow):
            together.setdefault(r.marks.value, []).append((i, r))
    for i, r in rules:
        if isinstance(r.marks, CountWindow):
            together.setdefault(next(iter(together), None), []).append((i, r))
        elif not isinstance(r.marks, DistinctWindow):
            apart.append((i, r))
    tables = [
        window_marks(df, [r.marks for _, r in group]).withColumnsRenamed(
            {f"from{k}": f"_from{i}" for k, (i, _) in enumerate(group)}
        )
        for group in together.values()
    ]
    tables += [r.marks(df).select(*MOMENT, F.col("from_key").alias(f"_from{i}")) for i, r in apart]
    if len(tables) == 1 and not apart:
        return tables[0]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return union.groupBy(*MOMENT).agg(*[F.min(f"_from{i}").alias(f"_from{i}") for i, _ in rules])


def _bit_of_moment() -> tuple[Column, Column]:
    """(word, bit) of a moment in a bit table of fixed size."""
    h = F.xxhash64(*MOMENT)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(F.shiftright(h, 6), F.lit(MARK_WORDS)).alias("_word"), bit.alias("_bit")


def prune_unmarked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` without most of those whose moment is not in ``marks`` (a stored table).

    The moments are hashed to the bits of at most ``MARK_WORDS`` words, which are
    broadcast: a table of bounded size however many marks there are. No marked row is
    lost; with M marks, an unmarked row stays with a chance of M / (64 * MARK_WORDS).
    """
    word, bit = _bit_of_moment()
    bits = marks.select(word, bit).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    timed = rows.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in MOMENT])).select("*", word, bit)
    return timed.join(F.broadcast(bits), "_word").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(*rows.columns)


def _window_hits(
    df: DataFrame, keep: list[str], words: list[str], rules: list[tuple[int, WindowRule]]
) -> DataFrame:
    """The marks of all rules, one row per moment, meet the events of those moments.

    The marks are stored, so that the join reads two plain inputs and Spark can split it
    where a moment is hot, or broadcast the marks where they are few. Events of moments
    without a mark are dropped where they are read.
    """
    merged = materialize(_merged_marks(df, rules))
    used = [c for c in df.columns if any(c in r.needs for _, r in rules)]
    rows = prune_unmarked(df.select(*dict.fromkeys([*keep, *used])), merged).join(merged, MOMENT)
    bits = {w: _none() for w in words}
    for i, r in rules:
        hit = F.coalesce(marked(F.col(f"_from{i}")), F.lit(False)) & r.eligible(df)
        word = i // WORD_BITS
        bits[words[word]] = bits[words[word]].bitwiseOR(F.when(hit, _bit(i, word)).otherwise(_none()))
    judged = rows.withColumns(bits)
    any_hit = reduce(Column.__or__, [F.col(w) != 0 for w in words])
    # Behind explode() the rows are not known to be dealt by moment: the merge deals them
    # anew, after summing in every task, and so Spark is free to split a hot moment here.
    hits = judged.where(any_hit).select(F.explode(F.array(F.struct(*keep, *words))).alias("_hit"))
    return hits.select("_hit.*", _no_texts())
