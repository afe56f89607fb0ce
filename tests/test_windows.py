"""Window operators against plain loops over random rows with many ties."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import detect, windows
from duskwatch.operators.detect import Detector
from duskwatch.operators.rules import brute_force, user_probing
from duskwatch.operators.windows import CountWindow, DistinctWindow, trailing_counts, window_marks
from duskwatch.scratch import materialize

from .helpers import frame

START = datetime(2024, 1, 1, 0, 59, 0)


def random_rows(seed, n, span, ips=3, users=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        # half of the rows come from one address, many at full hours and minutes
        ip = "0.0.0.0" if rng.random() < 0.5 else f"10.0.0.{rng.randrange(ips)}"
        second = rng.choice([rng.randrange(span), 60 * rng.randrange(span // 60 + 1)])
        rows.append(
            {
                "datetime": START + timedelta(seconds=second),
                "ip_origen": ip,
                "usuario": f"u{rng.randrange(users)}",
                "status": rng.choice(["FAIL", "FAIL", "SUCCESS"]),
                "file_path": f"f{rng.randrange(2)}",
                "block": rng.randrange(2),
            }
        )
    return rows


def in_order(rows):
    return sorted(
        enumerate(rows), key=lambda p: (p[1]["datetime"], p[1]["file_path"], p[1]["block"], p[0])
    )


def trailing(rows, keep, inside):
    """Row number -> earlier rows (and itself) of the same address in its window."""
    ordered = [(i, r) for i, r in in_order(rows) if keep(r)]
    out = {}
    for at, (i, r) in enumerate(ordered):
        out[i] = [
            o
            for _, o in ordered[: at + 1]
            if o["ip_origen"] == r["ip_origen"] and inside(r["datetime"] - o["datetime"])
        ]
    return out


@pytest.mark.parametrize("seed,span", [(1, 600), (2, 4000), (3, 60)])
def test_brute_force_counts_by_position(spark, seed, span):
    rows = random_rows(seed, 400, span)
    seen = trailing(rows, lambda r: r["status"] == "FAIL", lambda d: d <= timedelta(seconds=60))
    want = {i for i, w in seen.items() if len(w) >= 6}
    got = {r.line_no for r in brute_force().evaluate(frame(spark, rows)).collect()}
    assert want and got == want


@pytest.mark.parametrize("seed,span,users", [(1, 9000, 6), (2, 1200, 4), (3, 20000, 9), (4, 60, 30)])
def test_user_probing_counts_distinct_users_by_position(spark, seed, span, users):
    rows = random_rows(seed, 400, span, users=users)
    seen = trailing(rows, lambda r: True, lambda d: d <= timedelta(minutes=10))
    want = {i for i, w in seen.items() if len({o["usuario"] for o in w}) >= 4}
    got = {r.line_no for r in user_probing().evaluate(frame(spark, rows)).collect()}
    assert want and got == want


@pytest.mark.parametrize("limit,seconds", [(1, 60), (2, 10), (10, 7200)])
def test_other_limits_and_windows(spark, limit, seconds):
    rows = random_rows(5, 300, 9000)
    near = trailing(rows, lambda r: r["status"] == "FAIL", lambda d: d.total_seconds() <= seconds)
    want = {i for i, w in near.items() if len(w) >= limit}
    got = brute_force(limit, seconds).evaluate(frame(spark, rows))
    assert {r.line_no for r in got.collect()} == want
    seen = trailing(rows, lambda r: True, lambda d: d.total_seconds() <= seconds)
    want = {i for i, w in seen.items() if len({o["usuario"] for o in w}) >= limit}
    got = user_probing(limit, seconds).evaluate(frame(spark, rows))
    assert {r.line_no for r in got.collect()} == want


def test_requests_per_minute_window_is_open_on_the_left(spark):
    times = [0, 30, 60, 61, 119, 120]
    rows = [{"datetime": START + timedelta(seconds=s), "ip_origen": "a"} for s in times]
    got = trailing_counts(frame(spark, rows), 60, "rpm").orderBy("line_no").collect()
    assert [r.rpm for r in got] == [1, 2, 2, 3, 3, 3]


@pytest.mark.parametrize("seed,span", [(1, 600), (2, 7300), (3, 30)])
def test_requests_per_minute(spark, seed, span):
    rows = random_rows(seed, 500, span)
    # line numbers far apart, so that runs of lines are crossed
    for i, r in enumerate(rows):
        r["line_no"] = i * 40_000
    seen = trailing(rows, lambda r: True, lambda d: d < timedelta(seconds=60))
    got = trailing_counts(frame(spark, rows), 60, "rpm").collect()
    assert len(got) == len(rows)
    assert {r.line_no // 40_000: r.rpm for r in got} == {i: len(w) for i, w in seen.items()}


def test_sub_second_times(spark):
    rows = [
        {"datetime": START + timedelta(milliseconds=400 * i), "ip_origen": "a", "status": "FAIL"}
        for i in range(8)
    ]
    got = brute_force(3, 1).evaluate(frame(spark, rows)).collect()
    assert {r.line_no for r in got} == {2, 3, 4, 5, 6, 7}


def test_no_pass_over_a_whole_address(spark):
    """Every window groups by moment, slot or run of lines besides the address."""
    rows = random_rows(1, 50, 600)
    for df in (
        brute_force().evaluate(frame(spark, rows)),
        user_probing().evaluate(frame(spark, rows)),
        trailing_counts(frame(spark, rows), 60, "rpm"),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(ip_origen" in plan
        for part in plan.split("hashpartitioning(ip_origen")[1:]:
            assert part.split(")")[0].count(",") > 1


def hot_moment(spark, n=6000):
    """All rows of one address in one second, over several files, plus a few others."""
    hot = spark.range(n).selectExpr(
        "concat('f', id % 3) AS file_path",
        "id % 2 AS block",
        "id AS line_no",
        "timestamp_ntz'2024-01-01 00:59:59' AS datetime",
        "'0.0.0.0' AS ip_origen",
        "concat('u', id) AS usuario",
        "'FAIL' AS status",
        "concat('action ', id) AS accion",
    )
    cold = spark.range(60).selectExpr(
        "'g' AS file_path",
        "0L AS block",
        "id AS line_no",
        "timestamp_ntz'2024-01-01 01:00:00' + make_interval(0, 0, 0, 0, 0, id) AS datetime",
        "concat('10.0.0.', id) AS ip_origen",
        "'u' AS usuario",
        "'FAIL' AS status",
        "'x' AS accion",
    )
    return hot.unionByName(cold)


def test_one_moment_with_nearly_all_rows(spark):
    df = hot_moment(spark)
    # in line order, the first five (three) rows of the moment are no findings yet
    first = [r.line_no for r in df.where("file_path = 'f0' AND block = 0").orderBy("line_no").limit(5).collect()]
    everything = set(range(6000))
    hot = "file_path <> 'g'"
    got = {r.line_no for r in brute_force().evaluate(df).where(hot).collect()}
    assert got == everything - set(first)
    got = {r.line_no for r in user_probing().evaluate(df).where(hot).collect()}
    assert got == everything - set(first[:3])
    counts = trailing_counts(df, 60, "rpm").where(hot).orderBy("file_path", "block", "line_no").collect()
    assert [r.rpm for r in counts] == list(range(1, 6001))


def test_a_skewed_moment_is_split_in_the_join(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        alerts = Detector([brute_force(), user_probing()]).alerts(hot_moment(spark))
        assert len(alerts.collect()) == 5997
        plan = alerts._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def planned(monkeypatch, modules, run):
    """The plans of all tables that ``run`` stores, and of what it returns."""
    plans = []

    def keep(df, path=None):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, path)

    for module in modules:
        monkeypatch.setattr(module, "materialize", keep)
    out = run()
    return [*plans, out._jdf.queryExecution().executedPlan().toString()]


ALL = [
    CountWindow(lambda df: F.col("status") == "FAIL", 6, 60), DistinctWindow("usuario", 4, 600),
    CountWindow(lambda df: F.col("status") == "SUCCESS", 3, 5), DistinctWindow("usuario", 2, 30),
]


@pytest.mark.parametrize("seed, span", [(1, 40), (2, 600), (3, 9000)])
def test_windows_together_mark_what_they_mark_apart(spark, seed, span):
    df = frame(spark, random_rows(seed, 300, span))
    together = window_marks(df, ALL).collect()
    assert len({(r.ip_origen, r.datetime) for r in together}) == len(together)
    for i, window in enumerate(ALL):
        apart = window_marks(df, [window]).collect()
        assert {tuple(r) for r in apart} == {
            (r.ip_origen, r.datetime, r[f"from{i}"]) for r in together if r[f"from{i}"] is not None
        }
    assert together


def test_distinct_windows_over_two_columns_are_refused_together(spark):
    with pytest.raises(ValueError, match="accion"):
        window_marks(frame(spark, random_rows(1, 5, 9)), [DistinctWindow("usuario", 2, 9), DistinctWindow("accion", 2, 9)])


def test_all_window_rules_take_one_scan_and_few_exchanges(spark, monkeypatch):
    df = frame(spark, random_rows(1, 200, 600))
    plans = planned(monkeypatch, [windows], lambda: window_marks(df, ALL))
    assert sum(p.count("Scan ExistingRDD") for p in plans) == 1
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 6


def test_addresses_of_few_rows_are_marked_in_one_exchange(spark, monkeypatch):
    df = frame(spark, random_rows(1, 200, 600))
    plans = planned(monkeypatch, [windows], lambda: window_marks(df, ALL))
    assert sum(p.count("Exchange hashpartitioning") for p in plans) == 1


@pytest.mark.parametrize("seed, span", [(1, 40), (2, 600), (3, 9000)])
def test_hot_addresses_are_marked_like_others(spark, monkeypatch, seed, span):
    rows = random_rows(seed, 300, span)
    # null users, and lines that repeat
    rows += [{**r, "usuario": None} for r in rows[:40]] + [{**r, "line_no": i} for i, r in enumerate(rows[:40])]
    df = frame(spark, rows)
    plain = sorted(map(tuple, window_marks(df, ALL).collect()))
    for share in (1 << 30, 2, 1):
        monkeypatch.setattr(windows, "SMALL_GROUP", 1)
        monkeypatch.setattr(windows, "FAIR_SHARES", share)
        assert sorted(map(tuple, window_marks(df, ALL).collect())) == plain
    assert plain


@pytest.mark.parametrize("seed, span", [(1, 40), (3, 9000)])
def test_hot_addresses_are_counted_like_others(spark, monkeypatch, seed, span):
    df = frame(spark, random_rows(seed, 300, span))
    plain = sorted(map(tuple, trailing_counts(df, 60, "rpm").collect()))
    monkeypatch.setattr(windows, "SMALL_GROUP", 1)
    for share in (2, 1 << 30):
        monkeypatch.setattr(windows, "FAIR_SHARES", share)
        assert sorted(map(tuple, trailing_counts(df, 60, "rpm").collect())) == plain
    assert len(plain) == 300


def test_rows_are_counted_with_one_exchange(spark, monkeypatch):
    df = frame(spark, random_rows(1, 200, 600))
    plans = planned(monkeypatch, [windows], lambda: trailing_counts(df, 60, "rpm"))
    assert sum(p.count("Exchange hashpartitioning") for p in plans) == 1


def test_unmarked_events_do_not_reach_the_shuffle(spark):
    rows = materialize(spark.range(20_000).selectExpr("concat('10.0.', id % 500) AS ip_origen", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) AS datetime", "id"))
    marks = materialize(rows.where("id % 1000 = 3").select("ip_origen", "datetime"))
    kept = detect.prune_unmarked(rows, marks)
    assert {r.id for r in kept.collect()} >= set(range(3, 20_000, 1000)) and kept.count() < 30
    joined = kept.join(marks.hint("merge"), ["ip_origen", "datetime"])
    lines = joined._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffle = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(ip_origen" in x)
    prune = next(i for i, x in enumerate(lines) if "BroadcastHashJoin [_word" in x)
    assert prune > shuffle and lines[prune].index("Broadcast") > lines[shuffle].index("Exchange")


def test_rows_without_time_or_address_are_pruned_and_a_full_table_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(detect, "MARK_WORDS", 2)
    rows = spark.range(3000).selectExpr("if(id % 7 = 0, null, concat('a', id)) AS ip_origen", "if(id % 5 = 0, null, timestamp_ntz'2024-01-01') AS datetime", "id")
    kept = detect.prune_unmarked(rows, materialize(rows.select("ip_origen", "datetime").where("ip_origen is not null and datetime is not null")))
    assert {r.id for r in kept.collect()} == {i for i in range(3000) if i % 7 and i % 5}
    assert detect.prune_unmarked(rows, rows.limit(0).select("ip_origen", "datetime")).count() == 0


def test_sorted_alerts_are_merged_once(spark, monkeypatch):
    df = materialize(frame(spark, random_rows(1, 50, 600)))
    plans = planned(monkeypatch, [detect, windows], lambda: Detector([brute_force()]).run(df))
    assert "Aggregate" in plans[-2] and "Aggregate" not in plans[-1] and "rangepartitioning" in plans[-1]
