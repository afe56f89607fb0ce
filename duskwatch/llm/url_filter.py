"""URL filtering: host suffixes times path prefixes, joined by short hashes, digests confirmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column, sizes: list[int]) -> Column:
    """Those of the host and the domains it is part of that have one of ``sizes`` labels."""
    dots = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit("")))
    suffixes = [F.when(dots >= n - 1, F.substring_index(host, ".", -n)) for n in sizes]
    return F.array_compact(F.array(*suffixes).cast("array<string>"))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _short(expression: Column) -> Column:
    return F.shiftright(F.xxhash64(expression), 32).cast("int")


def _digest(expression: Column) -> Column:
    return F.unhex(F.sha2(expression, 256))


def filter_urls(urls: DataFrame, rules: DataFrame, url_column: str = "url", default: str = ALLOW) -> DataFrame:
    """All columns of ``urls`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has (host, path, verdict). A rule fits its host and all subdomains if the
    path of the url starts with the rule's. The longest rule (host and path together)
    wins, a block rule before an allow rule of the same text. Without a rule, ``rule`` is
    null and the verdict ``default``. A null url, or one without ``://``, has an empty
    host and path. Repeated rows stay; columns of these four names are replaced. Null
    hosts or paths of rules count as empty; without rules all urls get ``default``.

    Every url is spread into the pairs of a host suffix of as many labels as some rule's
    host and a path prefix as long as some rule's path, so a host or path of any length
    makes no more pairs than the rules have such sizes; they are joined with the rules on
    32 bits of a hash; SHA-256 digests confirm. An empty table gives an empty table. The rows of a url meet again by its row number, in the only shuffle; page
    bodies should be left out. Spark broadcasts the rules if their size allows.
    """
    clean = rules.select(
        F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("h"),
        F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"),
    ).distinct()
    # the lengths of paths and the labels of hosts in rules: short lists, whatever the number of rules
    lengths = sorted(r[0] for r in clean.select(F.length("p")).distinct().collect())
    sizes = sorted(r[0] for r in clean.select(F.size(F.split("h", r"\.", -1))).distinct().collect())
    known = clean.select(
        _short(_expression(F.col("h"), F.col("p"))).alias("_short"),
        _digest(_expression(F.col("h"), F.col("p"))).alias("_digest"),
        F.struct(
            (F.length("h") + F.length("p")).alias("size"), (F.col("v") == BLOCK).alias("blocks"),
            F.concat("h", "p").alias("rule"), F.col("v").alias("verdict"),
        ).alias("_fit"),
    )
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    parted = urls.select(
        F.struct(*[urls[c] for c in own]).alias("_in"), url_host(urls[url_column]).alias("host"),
        url_path(urls[url_column]).alias("path"), F.monotonically_increasing_id().alias("_row"),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length("path") >= n, F.left("path", F.lit(n))) for n in lengths]).cast("array<string>"),
        lambda p: p.isNotNull(),
    )
    pairs = F.flatten(F.transform(host_suffixes(F.col("host"), sizes), lambda h: F.transform(prefixes, lambda p: _expression(h, p))))
    spread = parted.select("*", F.explode_outer(pairs).alias("_pair")).withColumn("_short", _short(F.col("_pair")))
    met = spread.join(known, "_short", "left").withColumn(
        "_fit", F.when(_digest(F.col("_pair")) == F.col("_digest"), F.col("_fit"))
    )
    best = met.groupBy("_row").agg(
        F.max("_fit").alias("_fit"), *[F.first(c).alias(c) for c in ("_in", "host", "path")]
    )
    return best.select(
        "_in.*", "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", F.lit(default)).alias("verdict"),
    )
