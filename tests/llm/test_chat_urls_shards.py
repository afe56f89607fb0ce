import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duskwatch.llm import chat_format, sharding, url_filter

TURNS = "conv_id bigint, turn bigint, role string, text string, formatted int"


def read_back(spark, rows):
    done = chat_format.format_conversations(spark.createDataFrame(rows, TURNS))
    return {
        r["conv_id"]: r
        for r in done.select(
            "conv_id", "formatted", "loss_spans",
            chat_format.read_turns(F.col("formatted")).alias("turns"),
            chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        ).collect()
    }


def test_one_conversation(spark):
    rows = [(1, 2, "assistant", "b<c", 0), (1, 0, "user", "hi", 0), (1, 1, "assistant", "a", 0)]
    r = read_back(spark, rows)[1]
    assert r["formatted"] == "<turn:user>hi</turn><turn:assistant>a<+>b\\lc</turn>"
    assert [tuple(t) for t in r["turns"]] == [("user", "hi"), ("assistant", "a"), ("assistant", "b<c")]
    assert r["loss"] == "ab<c"
    assert [r["formatted"][s["start"] :][: s["length"]] for s in r["loss_spans"]] == ["a", "b\\lc"]


def test_anything_comes_back(spark):
    rng = random.Random(2)
    bits = ["</turn>", "<+>", "<turn:assistant>", "\\", "\\l", "\\b", "<", ">", "b", "l", "g", "\n", "é😀", "", "### Assistant:"]
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 7)):
            role = rng.choice(["user", "assistant", "system", "", None, "a>b<\\"])
            text = rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])
            rows.append((c, t, role, text, t))
    got = read_back(spark, rows)
    for c in range(40):
        want = [(r or "", x or "") for k, _, r, x, _ in rows if k == c]
        assert [tuple(t) for t in got[c]["turns"]] == want
        assert got[c]["loss"] == "".join(x for r, x in want if r == "assistant")


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(None, None, "user", "b", 0), (None, None, "user", "a", 0), (2, 1, "user", "x" * 200_000, 0), (2, 1, "user", "x" * 200_000, 0)]
    got = read_back(spark, rows)
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "a"), ("user", "b")]
    assert len(got[2]["turns"]) == 2 and got[2]["loss"] == "" and got[2]["loss_spans"] == []
    assert chat_format.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es", "block"),
    ("tie.org", "/", "allow"), ("tie.org", "/", "block"),
]


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        ("http://WWW.Example.COM/en/x?q=://a", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("x://m.example.com/en/#f/g", "m.example.com", "/en/", "example.com/en/", "block"),
        ("https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("https://a.com", "a.com", "", None, "allow"),
        ("https://a.net/essay", "a.net", "/essay", "net/es", "block"),
        ("https://?/en", "", "", None, "allow"),
        ("https://tie.org/a\nb", "tie.org", "/a\nb", "tie.org/", "block"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
    ],
)
def test_verdicts(spark, url, host, path, rule, verdict):
    urls = spark.createDataFrame([(1, url, "mine")], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert [tuple(r) for r in url_filter.filter_urls(urls, rules).collect()] == [(1, url, host, path, rule, verdict)]


def test_repeated_urls_and_no_rules(spark):
    urls = spark.createDataFrame([(1, "a://b.com/"), (1, "a://b.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert url_filter.filter_urls(urls, rules).count() == 2
    assert [r["verdict"] for r in url_filter.filter_urls(urls, rules.limit(0), default="block").collect()] == ["block"] * 2
    assert url_filter.filter_urls(urls.limit(0), rules).count() == 0


def test_url_plan_is_native(spark):
    urls = spark.createDataFrame([(1, "a://b.com/")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_filter.filter_urls(urls, rules)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def shard(spark, rows, shards=4, buckets=None):
    table = spark.createDataFrame(rows, "doc_id bigint, text string, slot string")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    return sharding.shard_rows(table, size, F.coalesce("text", F.lit("")), shards).toPandas()


def test_shards_are_even_and_groups_whole(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 400) + str(rng.randint(0, 9)), "s") for i in range(3000)]
    rows += [(5000 + i, "same" * 50, None) for i in range(500)] + [(7, None, None), (7, None, None)]
    got = shard(spark, rows)
    sizes = got.assign(size=[len((t or "").encode()) + 16 for t in got["text"]]).groupby("shard")["size"].sum()
    assert len(sizes) == 4 and sizes.max() - sizes.min() < 1000
    assert (got.fillna("").groupby("text")["shard"].nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert len(got) == len(rows)


def test_schedule_as_a_plain_loop():
    rng = random.Random(4)
    sizes = [rng.randint(1, 50) for _ in range(200)]
    loads, want = [3.0, 0.0, 9.0], {}
    held = list(loads)
    for i in sorted(range(200), key=lambda i: -sizes[i]):
        want[i] = held.index(min(held))
        held[want[i]] += sizes[i]
    assert sharding.schedule(sizes, loads) == [want[i] for i in range(200)]


def test_many_buckets_and_parts(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("group"), (F.col("id") % 97 + 1).alias("bytes"), F.monotonically_increasing_id().alias("_row")
    )
    placed = rows.join(sharding.shard_groups(rows.select("group", "bytes"), 5, bucket_groups=300), "group")
    got = sharding.with_slots(placed, numbered_rows=50).toPandas()
    sums = got.groupby("shard")["bytes"].sum()
    assert sums.max() - sums.min() < 0.01 * sums.mean()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_no_rows(spark):
    assert len(shard(spark, [])) == 0


def test_a_null_group_is_one_group(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, None, 5), (3, "b", 5), (4, None, 5), (5, "c", 10), (6, "d", None)], "doc_id bigint, g string, size bigint")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(rows, F.col("size"), F.col("g"), 3).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[2] == got[4]
    numbers = rows.select("doc_id", "size", F.when(F.col("g").isNotNull(), F.col("doc_id") + 2**60).alias("g"))
    got = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(numbers, F.col("size"), F.col("g"), 3).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6] and got[2] == got[4]
    alone = sharding.shard_rows(rows.where("g is null"), F.col("size"), F.col("g"), 3).collect()
    assert sorted(r["slot"] for r in alone) == [0, 1]


def test_very_long_hosts_and_paths(spark):
    host = "a." * 50_000 + "m.example.com"
    urls = spark.createDataFrame([(1, f"x://{host}/en/" + "p/" * 50_000), (2, "x://" + "." * 100_000)], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(urls, rules).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "allow")}


def test_rules_of_many_label_counts(spark):
    hosts = ["a", "b.a", "c.b.a", "", "x.", "b.a."]
    urls = spark.createDataFrame([(i, f"s://{h}/p") for i, h in enumerate([*hosts, "d.c.b.a", "ab.a", "y.x."])], "page_id bigint, url string")
    rules = spark.createDataFrame([(h, "/", "block") for h in hosts], "host string, path string, verdict string")
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(urls, rules).collect()}
    assert got == {0: "a/", 1: "b.a/", 2: "c.b.a/", 3: "/", 4: "x./", 5: "b.a./", 6: "c.b.a/", 7: "a/", 8: "x./"}


def test_a_conversation_of_very_many_turns(spark):
    n = 20_000
    turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "if(id % 7 < 3, 'assistant', 'user') AS role", "concat('é<', id) AS text", "0 AS formatted")
    (row,) = chat_format.format_conversations(turns).select(
        "loss_spans", chat_format.read_turns(F.col("formatted")).alias("turns"),
        chat_format.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    assert [t["text"] for t in row["turns"]] == [f"é<{i}" for i in range(n)]
    assert row["loss"] == "".join(f"é<{i}" for i in range(n) if i % 7 < 3)


def test_a_loss_text_longer_than_a_piece(spark):
    long = "".join(chr(0x61 + i % 26) + "😀" for i in range(6000))
    rows = [(1, 0, "user", "u" * 5000, 0), (1, 1, "assistant", long, 0), (1, 2, "assistant", "", 0), (1, 3, "assistant", "z" * 4096, 0)]
    assert read_back(spark, rows)[1]["loss"] == long + "z" * 4096
