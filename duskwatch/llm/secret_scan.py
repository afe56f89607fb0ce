"""Secret scans by a trigram index, in Spark expressions only.

A rule is a regular expression. Every match of it holds certain runs of three characters,
so the rule gives a Boolean query over trigrams: an OR of ANDs. One pass over the texts
writes the postings of all trigrams that some rule asks for, (trigram, text); the lists
of a query are intersected, and only texts that satisfy it are searched. A rule whose
matches need no trigram (say, a run of hexadecimal digits) is searched in the first pass,
in every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as kinds
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bound, running_sums, stored

# Strings that part of an expression may stand for, and ANDs of a query, before it is
# given up to ask for less. Both bound work on a rule, not what it finds.
_MOST_STRINGS = 64
_MOST_TERMS = 64

# Trigrams for each column of bits.
_BITS = 63


@dataclass(frozen=True)
class SecretRule:
    """``pattern`` in the syntax that Java and Python share; matches are leftmost and do not overlap.

    Matches whose ``group`` has fewer than ``least`` characters are dropped (and what
    they hold is not searched again). Patterns match at least one character.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


# Fixed kinds and patterns, in the order in which spans are told. A run of 24 or more is
# the same as a whole run that has 24 or more, so hex and access need no least length.
BASE_RULES = [
    SecretRule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=6, group=2,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
]

# A query: an OR of sets of trigrams, all of which a text must hold. An empty set asks for nothing.
Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])


def _simple(terms) -> Query:
    """Without terms that ask for more than another one."""
    terms = set(terms)
    return frozenset(t for t in terms if not any(o < t for o in terms))


def _both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > _MOST_TERMS:
        return min(a, b, key=len)
    return _simple(x | y for x, y in product(a, b))


def _either(queries: list[Query]) -> Query:
    out = _simple(t for q in queries for t in q)
    return out if len(out) <= _MOST_TERMS else _ANY


def _of_strings(strings: frozenset[str]) -> Query:
    """What a text that holds one of the strings must hold."""
    return _either([frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]) for s in strings])


def _letters(code: int) -> frozenset[str] | None:
    """A character as the index holds it: lower-cased; None if case may change it in other ways."""
    return frozenset(chr(code).lower()) if code < 128 else None


def _class(items) -> frozenset[str] | None:
    found = set()
    for op, arg in items:
        if op is kinds.LITERAL and arg < 128:
            found |= _letters(arg)
        elif op is kinds.RANGE and arg[1] < 128 and arg[1] - arg[0] < _MOST_STRINGS:
            found |= {c for x in range(arg[0], arg[1] + 1) for c in _letters(x)}
        else:
            return None
    return frozenset(found) if 0 < len(found) <= 4 else None


def _read(node) -> tuple[frozenset[str] | None, Query]:
    """(all strings that the node stands for, or None; what they all need)."""
    op, arg = node
    if op is kinds.LITERAL:
        return _letters(arg), _ANY
    if op is kinds.IN:
        return _class(arg), _ANY
    if op is kinds.AT:
        return frozenset([""]), _ANY
    if op is kinds.SUBPATTERN:
        return _read_all(arg[3])
    if op is kinds.BRANCH:
        ways = [_read_all(x) for x in arg[1]]
        strings = [s for s, _ in ways]
        if all(s is not None for s in strings) and sum(map(len, strings)) <= _MOST_STRINGS:
            return frozenset().union(*strings), _ANY
        return None, _either([_both(q, _of_strings(s)) if s is not None else q for s, q in ways])
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
        low, high, inner = arg
        strings, needs = _read_all(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, _ANY
        if low == high and strings is not None and len(strings) ** low <= _MOST_STRINGS:
            return frozenset(map("".join, product(strings, repeat=low))), _ANY
        if low == 0:
            return None, _ANY
        return None, needs if strings is None else _both(needs, _of_strings(strings))
    return None, _ANY


def _read_all(nodes) -> tuple[frozenset[str] | None, Query]:
    run, needs, whole = frozenset([""]), _ANY, True
    for node in nodes:
        strings, asked = _read(node)
        needs = _both(needs, asked)
        if strings is not None and len(strings) * len(run) <= _MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
            continue
        whole = False
        needs = _both(needs, _of_strings(run))
        run = strings if strings is not None else frozenset([""])
    return (run, needs) if whole else (None, _both(needs, _of_strings(run)))


def trigram_query(pattern: str) -> Query:
    """What every text that the pattern matches somewhere must hold, lower-cased."""
    strings, needs = _read_all(parser.parse(pattern))
    return needs if strings is None else _both(needs, _of_strings(strings))


def needs_nothing(query: Query) -> bool:
    return frozenset() in query


def find_spans(text: Column, rule: SecretRule) -> Column:
    """array of (start, end) of all matches of a rule, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    between = F.transform(F.split(text, rule.pattern, -1), lambda b: F.length(b))
    # n matches stand between n + 1 pieces
    sizes = F.zip_with(between, matches, lambda b, m: F.struct(b.alias("b"), F.length(m).alias("m")))
    found = F.filter(sizes, lambda x: x["m"].isNotNull())
    ends = bound(found, lambda f: bound(F.transform(f, lambda x: x["b"] + x["m"]), running_sums))
    spans = F.zip_with(
        F.zip_with(matches, parts, lambda m, p: F.struct(F.length(m).alias("size"), (F.length(p) >= rule.least).alias("kept"))),
        ends,
        lambda m, end: F.struct(
            (end - m["size"]).cast("long").alias("start"), end.cast("long").alias("end"), m["kept"].alias("kept")
        ),
    )
    kept = F.transform(
        F.filter(spans, lambda s: s["kept"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    )
    return F.when(text.rlike(rule.pattern), kept).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _spans_of(text: Column, rules: list[tuple[int, SecretRule]], wanted=None) -> Column:
    """array of (start, rule, end) of several rules; ``wanted`` says for each whether it is searched."""
    none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
    found = [none]
    for number, rule in rules:
        named = F.lit(number).alias("rule")
        spans = F.transform(find_spans(text, rule), lambda s: F.struct(s["start"].alias("start"), named, s["end"].alias("end")))
        found.append(spans if wanted is None else F.when(wanted(number), spans).otherwise(none))
    return F.concat(*found)


def _candidates(postings: DataFrame, queries: dict[int, Query], grams: list[str]) -> DataFrame:
    """(text_key, rules): the texts that satisfy a query, with the numbers of those rules.

    The lists are intersected as bits: one row per text, made map-side as far as a task
    holds the postings of a text.
    """
    place = {g: divmod(i, _BITS) for i, g in enumerate(grams)}
    words = range(max(w for w, _ in place.values()) + 1)
    bit = F.create_map(*[F.lit(x) for g, (_, b) in place.items() for x in (g, 1 << b)])
    word = F.create_map(*[F.lit(x) for g, (w, _) in place.items() for x in (g, w)])
    marked = postings.where(F.col("gram").isin(grams)).select(
        "text_key", bit[F.col("gram")].cast("long").alias("bit"), word[F.col("gram")].alias("word")
    )
    lists = marked.groupBy("text_key").agg(
        *[F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words]
    )

    def holds(term: frozenset[str]) -> Column:
        masks = {w: sum(1 << b for v, b in map(place.get, term) if v == w) for w in words}
        return reduce(
            lambda a, b: a & b,
            [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) == m for w, m in masks.items() if m],
        )

    fits = {n: reduce(lambda a, b: a | b, [holds(t) for t in sorted(q, key=sorted)]) for n, q in queries.items()}
    rules = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in fits.items()]))
    return lists.select("text_key", rules.alias("rules")).where(F.size("rules") > 0)


def scan_secrets(
    docs: DataFrame, rules: list[SecretRule] | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(id, spans): one row per row of ``docs``; spans are (start, kind, end) by start, then rule.

    Offsets are code points, end exclusive. A null text is empty and has no span; rows
    with a null or repeated id stay as they are; equal texts have equal spans; an empty
    table gives an empty table; without rules no row has a span. Other columns are
    ignored, whatever their names. Texts of any length are searched whole.

    Texts are read twice: to write their digests, postings and the spans of rules that
    need no trigram, and again to search the candidates. The second read is narrowed by
    the 64-bit hashes of the candidates' texts; Spark broadcasts those if they are few. A
    text that only shares such a hash is searched in vain and changes nothing.
    """
    rules = BASE_RULES if rules is None else rules
    asked = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    everywhere = [(n, r) for n, r in enumerate(rules) if needs_nothing(asked[n])]
    indexed = {n: q for n, q in asked.items() if not needs_nothing(q)}
    grams = sorted({g for q in indexed.values() for t in q for g in t})
    text = F.coalesce(docs[text_column], F.lit(""))
    held = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in grams]))
    read = docs.select(docs[id_column].alias("id"), text.alias("t"), F.lower(text).alias("folded"))
    first = stored(
        read.select(
            "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.xxhash64("t").alias("text_key"),
            _spans_of(F.col("t"), everywhere).alias("spans"),
            (held if grams else F.array().cast("array<string>")).alias("grams"),
        )
    )
    kinds_of = F.array(*[F.lit(r.kind) for r in rules]) if rules else F.array().cast("array<string>")

    def told(spans: Column) -> Column:
        return F.transform(
            F.array_sort(spans),
            lambda s: F.struct(s["start"].alias("start"), F.get(kinds_of, s["rule"]).alias("kind"), s["end"].alias("end")),
        )

    if not indexed:
        return first.select(F.col("id").alias(id_column), told(F.col("spans")).alias("spans"))
    postings = stored(first.select(F.explode("grams").alias("gram"), "text_key").sortWithinPartitions("gram"))
    likely = stored(_candidates(postings, indexed, grams))
    again = docs.select(text.alias("t"), F.xxhash64(text).alias("text_key")).join(likely, "text_key")
    found = _spans_of(F.col("t"), [(n, rules[n]) for n in indexed], lambda n: F.array_contains("rules", F.lit(n)))
    verified = again.select(F.unhex(F.sha2("t", 256)).alias("digest"), found.alias("more")).where(F.size("more") > 0)
    more = stored(verified.groupBy("digest").agg(F.first("more").alias("more")))
    joined = first.join(more, "digest", "left")
    spans = F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more"))
    return joined.select(F.col("id").alias(id_column), told(spans).alias("spans"))
