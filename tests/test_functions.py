import math
import random
import zlib
from collections import Counter
from urllib.parse import unquote_plus

from pyspark.sql import functions as F

from duskwatch.functions.regex import java_regex, strip
from duskwatch.functions.text import adler32, batch_entropy, preview, shannon_entropy, url_decode
from duskwatch.operators.normalize import normalize

from .helpers import frame


def apply(spark, fn, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", fn(F.col("t")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


URLS = [
    "",
    "/plain",
    "/a+b%20c",
    "/x%zz%",
    "%",
    "%%41",
    "%4",
    "%C3%A9%C3",
    "%E2%82",
    "%E2%82%AC%F0%9F%98%80",
    "%ff%fe",
    "%ED%A0%80",
    "é%41é",
    "%+1%-1",
    "%2527",
    "a%00b",
    "%F0%9F%98x",
    "100%25+%26",
]


def test_url_decode_equals_the_standard_library(spark):
    rng = random.Random(7)
    noise = ["".join(rng.choice("%aC3f09+éZ") for _ in range(rng.randrange(12))) for _ in range(300)]
    texts = URLS + noise
    assert apply(spark, url_decode, texts) == [unquote_plus(t) for t in texts]
    assert apply(spark, url_decode, [None]) == [""]


def entropy(text):
    shares = [n / len(text) for n in Counter(text).values()]
    return -sum(p * math.log2(p) for p in shares)


def test_entropy(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab.*\n\\$é😀 ") for _ in range(rng.randrange(1, 60))) for _ in range(200)]
    texts += ["a", "aaaa", "ab", "x" * 5000, "GET /admin?id=1' OR '1'='1"]
    got = apply(spark, shannon_entropy, texts)
    assert all(abs(g - entropy(t)) < 1e-9 for g, t in zip(got, texts, strict=True))
    assert apply(spark, shannon_entropy, [""]) == [0.0]


def test_entropy_of_batches(spark):
    texts = ["", "a", "ab", None, "é😀é", "GET /admin?id=1' OR '1'='1", "ab", "x" * 5000]
    one, many = apply(spark, shannon_entropy, texts), apply(spark, batch_entropy, texts * 3)
    assert many[3] is None and [g is None for g in many] == [t is None for t in texts * 3]
    assert all(g is None or abs(g - w) < 1e-9 for g, w in zip(many, one * 3, strict=True))


def test_adler32_equals_zlib(spark):
    texts = ["", "0.0.0.0", "192.0.2.1", "255.255.255.255", "None", "é" * 40, "x" * 3000]
    assert apply(spark, adler32, texts) == [zlib.adler32(t.encode()) for t in texts]


def test_strip_knows_every_white_space(spark):
    texts = ["\x1c a \x1f", "\x85\xa0b ", "　c\t\x0b\x0c", "  ", "d"]
    assert apply(spark, strip, texts) == [t.strip() for t in texts]


def test_white_space_class(spark):
    texts = ["a\x1cb", "a b", "a b", "ab", "a\x0bb"]
    got = apply(spark, lambda c: c.rlike(java_regex(r"^a\sb$")), texts)
    assert got == [True, True, True, False, True]
    got = apply(spark, lambda c: c.rlike(java_regex(r"^\S+$")), texts)
    assert got == [False, False, False, True, False]


def test_preview_escapes_before_it_cuts(spark):
    long = "<" * 20
    assert apply(spark, preview, ["a<b>&\"'", long, "x" * 65, "x" * 66]) == [
        "a&lt;b&gt;&amp;&quot;&#x27;",
        ("&lt;" * 20)[:65] + "...",
        "x" * 65,
        "x" * 65 + "...",
    ]


def test_normalize_fills_and_decodes(spark):
    df = frame(spark, [{"url": "/a%27", "usuario": None, "ip_origen": None}, {"url": None}],
               ["url", "usuario", "ip_origen"])
    rows = normalize(df).orderBy("line_no").collect()
    assert [(r.url_decoded, r.usuario, r.ip_origen) for r in rows] == [
        ("/a'", "-", "0.0.0.0"),
        ("", "-", "0.0.0.0"),
    ]


def test_normalize_without_urls(spark):
    (row,) = normalize(frame(spark, [{"status": "FAIL"}])).collect()
    assert row.url_decoded == ""
