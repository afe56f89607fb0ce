"""Scalar text functions built from native expressions; only the entropy of batches uses Python workers."""

import math
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ADLER_MODULUS = 65521


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def url_decode(url: Column) -> Column:
    """Form-style URL decoding that never fails.

    ``+`` is a blank, runs of ``%XX`` are UTF-8 bytes (bad ones become U+FFFD) and
    escapes that are no escapes stay as they are. A null URL gives ''.
    """
    text = F.replace(F.coalesce(url, F.lit("")), F.lit("+"), F.lit(" "))
    pieces = F.regexp_extract_all(
        text, F.lit("(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0)
    )
    decoded = F.transform(
        pieces,
        lambda p: F.when(
            p.startswith("%") & (F.length(p) > 1),
            F.make_valid_utf8(F.unhex(F.replace(p, F.lit("%"), F.lit(""))).cast("string")),
        ).otherwise(p),
    )
    return F.when(F.contains(text, F.lit("%")), F.array_join(decoded, "")).otherwise(text)


def shannon_entropy(text: Column) -> Column:
    """Bits per character over the characters of ``text``; '' gives 0.

    Sorted characters form one run per distinct character, so the work grows with
    n log n, whatever the alphabet.
    """
    size = F.length(text)
    sorted_text = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(sorted_text, F.lit(r"(?s)(.)\1*"), F.lit(0))
    weight = F.aggregate(
        runs, F.lit(0.0), lambda acc, run: acc + F.length(run) * F.log2(F.length(run))
    )
    return F.when(size > 0, F.log2(size) - weight / size).otherwise(F.lit(0.0))


def batch_entropy(text: Column) -> Column:
    """:func:`shannon_entropy`, computed once for all equal texts of an Arrow batch; null gives null.

    Log messages repeat, and sorting the characters of each is what features cost most.
    """

    def bits_per_character(of: str) -> float:
        size = len(of)
        return math.log2(size) - sum(n * math.log2(n) for n in Counter(of).values()) / size if size else 0.0

    @F.pandas_udf("double")
    def entropy(texts: pd.Series) -> pd.Series:
        places, different = pd.factorize(texts)
        bits = pd.Series([*map(bits_per_character, different)], dtype="float64")
        return bits.reindex(places).reset_index(drop=True)

    return entropy(text)


def adler32(text: Column) -> Column:
    """Unsigned Adler-32 checksum of the UTF-8 bytes."""
    digits = F.hex(F.encode(text, "UTF-8"))
    size = F.length(digits) / 2

    def byte(i: Column) -> Column:
        return F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")

    places = F.when(size > 0, F.sequence(F.lit(1), size.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    low = F.aggregate(places, F.lit(1).cast("bigint"), lambda acc, i: acc + byte(i))
    # A byte at place i is counted once in every later prefix sum.
    high = F.aggregate(
        places,
        size.cast("bigint"),
        lambda acc, i: (acc + (size.cast("bigint") - i + 1) * byte(i)) % ADLER_MODULUS,
    )
    return (high % ADLER_MODULUS) * 65536 + low % ADLER_MODULUS


# HTML escapes, the ampersand first.
HTML_ESCAPES = [
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
]


def html_escape(text: Column) -> Column:
    for raw, safe in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def preview(text: Column, size: int = 65) -> Column:
    """Escaped text cut to ``size`` characters, with dots where something was cut."""
    safe = html_escape(text)
    return F.when(F.length(safe) > size, F.concat(F.substring(safe, 1, size), F.lit("..."))).otherwise(safe)
