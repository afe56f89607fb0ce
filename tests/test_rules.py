from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from duskwatch.functions.regex import any_of
from duskwatch.operators import rules as rule_sets
from duskwatch.operators.detect import Detector
from duskwatch.operators.normalize import normalize
from duskwatch.operators.rules import (
    FrameRule,
    RowRule,
    brute_force,
    default_rules,
    path_traversal,
    sql_injection,
    time_anomaly,
    user_probing,
    web_attack,
    xss_attack,
)

from .helpers import frame, login_rows

BASE = datetime(2026, 10, 11, 10, 0, 0)


def found_urls(spark, rule, rows, decode=True):
    df = frame(spark, rows)
    df = normalize(df) if decode else df
    return sorted(r.url for r in rule.evaluate(df).collect())


def urls(*texts):
    return [{"url": u, "ip_origen": "10.4.4.1", "status": "FAIL"} for u in texts]


# For each alternative of a rule's patterns, in their order: a text it hits, and one that
# comes near and is no hit.
SQL = [
    ("/shop?sort=\"#", "/shop?sort=\"up"),
    ("/f?owner=kim' ;", "/f?owner=kim' ,"),
    ("/l?c=7 uNiOn AlL sElEcT pin fRoM cards", "/l?c=7 union-select pin from cards"),
    ("/l?c=insert into logs(", "/l?c=insert into logs"),
    ("/l?c=DELETE  FROM carts WHERE", "/l?c=delete from carts"),
    ("/l?c=update staff set pay =", "/l?c=update staff set pay"),
    ("/l?c=drop database crm", "/l?c=drop schema crm"),
    ("/l?c=exec ( ", "/l?c=execute"),
    ("/l?c=xp_dirtree", "/l?c=xp-dirtree"),
    ("/l?c=benchmark(50", "/l?c=benchmark(x"),
    ("/l?c=sleep ( 3", "/l?c=asleep(3"),
    ("/l?c=4 ; exec", "/l?c=4; executive"),
]
XSS = [
    ("/c?t=<SCRIPT src=//x.test>\n</script>", "/c?t=<script src=//x.test>"),
    ("/c?to=JAVASCRIPT:go", "/c?to=javascript;go"),
    ("/c?t=onfocus = \"", "/c?t=onfocus = 7"),
    ("/c?t=alert (", "/c?t=alerts("),
    ("/c?t=document.cookie", "/c?t=document-cookie"),
    ("/c?t=document.location", "/c?t=document/location"),
    ("/c?t=window.location", "/c?t=windows.location"),
    ("/c?t=eval(", "/c?t=evaluate("),
    ("/c?t=string.fromcharcode", "/c?t=string.from"),
    ("/c?t=<iframe", "/c?t=< iframe"),
    ("/c?t=<object", "/c?t=object>"),
    ("/c?t=<embed", "/c?t=/embed"),
    ("/c?t=expression(", "/c?t=expressions"),
]
TRAVERSAL = [
    ("/img/../k", "/img/..-/k"),
    ("/img/..\\k", "/img/.\\k"),
    ("/img/..%2Fk", "/img/.%2fk"),
    ("/img/...././k", "/img/... /k"),
    ("/get?f=/etc/passwd", "/get?f=/etc/group"),
    ("/get?f=windows/win.ini", "/get?f=windows/win.txt"),
    ("/get?f=boot.ini", "/get?f=boot.in"),
    ("/img/..%c0%af", "/img/..%c0%ae"),
    ("/img/..%C1%9C", "/img/..%c1%9d"),
]


@pytest.mark.parametrize(
    "make, samples", [(sql_injection, SQL), (xss_attack, XSS), (path_traversal, TRAVERSAL)]
)
def test_every_pattern_and_its_near_miss(spark, make, samples):
    bad, good = ([pair[i] for pair in samples] for i in (0, 1))
    assert found_urls(spark, make(), urls(*bad, *good), decode=False) == sorted(bad)


def test_escapes_are_decoded_before_the_rules(spark):
    hidden = ["/q?k=%22%20Or%20%22a", "/q?k=a+uNION+select+b+from+c", "/q?k=%3Ciframe%20x", "/q/%2E%2e/%2E./etc"]
    rules = [sql_injection(), xss_attack(), path_traversal()]
    found = {u for rule in rules for u in found_urls(spark, rule, urls(*hidden))}
    assert found == set(hidden)
    assert not any(found_urls(spark, rule, urls(*hidden), decode=False) for rule in rules)


def test_words_that_only_look_like_attacks(spark):
    good = ["/teams/kim's-desk", "/union/selected-works", "/guides/dropdown-tables", "/a#part-2", "/people/d'arc/bio"]
    for rule in (sql_injection(), xss_attack(), path_traversal()):
        assert found_urls(spark, rule, urls(*good)) == []


def test_scripts_in_the_agent(spark):
    agents = [
        {"url": "/1", "user_agent": "probe eval(x)"},
        {"url": "/2", "user_agent": "Lynx/2.9"},
        {"url": "/3", "user_agent": None},
    ]
    assert found_urls(spark, xss_attack(), agents) == ["/1"]


def test_web_attack(spark):
    rows = [{"url": "/a", "attack_types": None}, {"url": "/b", "attack_types": ["probe", "flood"]}]
    (row,) = web_attack().evaluate(frame(spark, rows)).collect()
    assert row.reason == "Detected by Web Attack: probe, flood"
    assert (row.rule, row.severity) == ("Web Attack", "medium")


def test_time_anomaly(spark):
    def hours(*wanted):
        return frame(
            spark, [{"datetime": BASE.replace(hour=h), "status": "SUCCESS"} for h in wanted]
        )

    assert time_anomaly().evaluate(hours(3, 7, 8, 12, 17, 18, 23)).count() == 4
    assert time_anomaly(0, 24).evaluate(hours(3, 23)).count() == 0
    failed = frame(spark, [{"datetime": BASE.replace(hour=3), "status": "FAIL"}])
    assert time_anomaly().evaluate(failed).count() == 0


def test_six_failures_are_brute_force(spark):
    rows = login_rows(BASE, 6, "10.4.4.1", "omar", "wrong key", "FAIL", 5)
    (alert,) = Detector([brute_force()]).run(frame(spark, rows)).collect()
    assert alert.ip_origen == "10.4.4.1" and alert.datetime == BASE + timedelta(seconds=25)
    assert alert.reason == "Brute Force: Threshold reached (6+ failed logins)"
    assert Detector([brute_force()]).run(frame(spark, rows[:5])).count() == 0


def test_the_same_second_counts(spark):
    rows = login_rows(BASE, 6, "10.4.4.1", "omar", "wrong key", "FAIL", 0)
    assert [r.line_no for r in brute_force().evaluate(frame(spark, rows)).collect()] == [5]


def test_four_users_are_probing(spark):
    rows = [
        {
            "datetime": BASE + timedelta(minutes=2 * i),
            "ip_origen": "10.4.4.2",
            "usuario": u,
            "accion": f"wrong key from {u}",
            "status": "FAIL",
        }
        for i, u in enumerate(["ines", "otto", "raj", "yui"])
    ]
    (alert,) = Detector([user_probing()]).run(frame(spark, rows)).collect()
    assert "User Probing" in alert.reason and alert.usuario == "yui"


def test_missing_columns_give_nothing(spark):
    bare = frame(spark, [{"status": "FAIL"}])
    for rule in default_rules():
        out = rule.evaluate(bare)
        assert out.count() == 0
        assert out.columns[-3:] == ["reason", "rule", "severity"]
    assert Detector().run(bare).count() == 0
    assert Detector([]).run(frame(spark, [{"datetime": BASE}])).count() == 0


def test_null_users_and_actions_survive_the_merge(spark):
    rows = [
        {
            "timestamp": f"Oct 11 03:0{i}:00",
            "datetime": BASE.replace(hour=3, minute=i),
            "ip_origen": "10.4.4.7",
            "usuario": None,
            "accion": None,
            "status": "SUCCESS",
            "url": "/desk",
        }
        for i in range(3)
    ]
    alerts = Detector([time_anomaly()]).run(frame(spark, rows)).collect()
    assert len(alerts) == 3 and all(a.reason and a.usuario is None for a in alerts)


def test_rules_together(spark):
    def visit(seconds, ip, url, status="SUCCESS"):
        return {"datetime": BASE + timedelta(seconds=seconds), "ip_origen": ip, "status": status,
                "usuario": "mara", "accion": url, "url": url}

    rows = [visit(7 * i, "10.1.0.9", f"/door/{i}", "FAIL") for i in range(8)]
    rows += [visit(5, "10.1.0.4", "/q?k=eval(1)"), visit(900, "10.1.0.5", "/tea"), visit(901, "10.1.0.4", "/q?k=' or 2")]
    detector = Detector([xss_attack(), sql_injection(), brute_force()])
    got = [(r.accion, r.rule) for r in detector.run(normalize(frame(spark, rows))).collect()]
    assert got == [
        ("/q?k=eval(1)", "XSS Attack"), ("/door/5", "Brute Force"), ("/door/6", "Brute Force"),
        ("/door/7", "Brute Force"), ("/q?k=' or 2", "SQL Injection"),
    ]


def test_more_rules_than_a_word_has_bits(spark):
    rows = [{"datetime": BASE, "ip_origen": "a", "status": "INFO", "usuario": "u", "accion": str(i)} for i in range(70)]
    rules = [
        RowRule(f"R{i}", "high" if i == 65 else "low", ("accion",), lambda df, i=i: F.col("accion").cast("int") >= i, f"r{i}")
        for i in range(70)
    ]
    alerts = {r.accion: r for r in Detector(rules).run(frame(spark, rows)).collect()}
    assert alerts["69"].rule.split(" | ") == [f"R{i}" for i in range(70)]
    assert alerts["2"].reason == "r0 | r1 | r2"
    assert (alerts["64"].severity, alerts["65"].severity) == ("low", "high")
    found = Detector(rules).findings(frame(spark, rows)).where("accion = '66'").orderBy("ord").collect()
    assert [r.rule for r in found] == [f"R{i}" for i in range(67)]


def test_merge_joins_texts_and_takes_the_worst_severity(spark):
    row = {"datetime": BASE.replace(hour=2), "ip_origen": "a", "usuario": "u", "accion": "x",
           "status": "SUCCESS", "url": "/r?u=javascript:../etc/passwd"}
    rows = [
        {**row, "timestamp": "Oct  1 02:00:00", "attack_types": ["b"]},
        {**row, "timestamp": "Oct 01 02:00:00", "attack_types": ["a"]},
    ]
    (alert,) = Detector().run(frame(spark, rows)).collect()
    assert alert.rule == "Time Anomaly | XSS Attack | Path Traversal | Web Attack"
    assert alert.severity == "high" and alert.timestamp == "Oct  1 02:00:00"
    assert alert.reason == (
        "Time Anomaly: Login outside business hours | Detected by XSS Attack | "
        "Detected by Path Traversal | Detected by Web Attack: b | Detected by Web Attack: a"
    )


def test_reasons_stand_in_order_of_their_first_lines(spark):
    said = ["c", "a", "c", "b", "a", "d"]
    rows = [
        {"datetime": BASE, "ip_origen": "a", "usuario": "u", "accion": "x", "status": "INFO", "user_agent": s, "file_path": f, "line_no": i}
        for f in ("g", "f") for i, s in enumerate(said if f == "g" else said[::-1])
    ]
    rules = [
        RowRule("Agent", "low", ("user_agent",), lambda df: F.col("user_agent") != "c", lambda: F.col("user_agent")),
        RowRule("Again", "low", ("user_agent",), lambda df: F.lit(True), lambda: F.concat(F.lit("is "), "user_agent")),
    ]
    (alert,) = Detector(rules).run(frame(spark, rows).repartition(5)).collect()
    assert alert.reason == "d | a | b | is d | is a | is b | is c"


def test_a_second_rule_of_the_same_name_is_ignored(spark):
    detector = Detector([time_anomaly(), time_anomaly(0, 24)])
    detector.add_rule(time_anomaly(1, 2))
    assert detector.active_rules == ["Time Anomaly"]


def test_own_rules(spark):
    rows = [{"datetime": BASE, "ip_origen": "a", "status": s, "usuario": "u", "accion": "x"}
            for s in ("FAIL", "INFO")]
    own = RowRule("Any Failure", "HIGH", ("status",), lambda df: F.col("status") == "FAIL", "failed")
    other = FrameRule("Info", "odd", ("status",), lambda df: df.where("status = 'INFO'"), "info")
    got = Detector([own, other]).run(frame(spark, rows)).collect()
    assert [(r.status, r.rule, r.reason, r.severity) for r in got] == [
        ("FAIL", "Any Failure", "failed", "HIGH"),
        ("INFO", "Info", "info", "odd"),
    ]


def test_row_rules_do_not_repeat_the_patterns(spark, tmp_path):
    path = str(tmp_path / "events")
    normalize(frame(spark, urls("/a"))).write.parquet(path)
    hits = Detector([sql_injection(), path_traversal()]).hits(spark.read.parquet(path))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    # once in the one expression that judges a row, for each column the rule looks at
    assert plan.count("xp_") == plan.count("boot") * len(("url_decoded",)) == 1


@pytest.mark.parametrize("name, samples", [("SQL", SQL), ("XSS", XSS), ("TRAVERSAL", TRAVERSAL)])
def test_a_match_begins_with_a_stated_character(spark, name, samples):
    patterns, starts = getattr(rule_sets, f"{name}_PATTERNS"), getattr(rule_sets, f"{name}_STARTS")
    texts = [(t,) for pair in samples for one in pair for t in (one, one.upper(), one.replace("s", "\u017f").replace("i", "\u0131"))]
    found = spark.createDataFrame(texts, "t string").select(
        F.regexp_extract("t", any_of(patterns), 0).alias("plain"), F.regexp_extract("t", any_of(patterns, starts), 0).alias("stated")
    )
    assert all(r.plain == r.stated for r in found.collect()) and found.where("plain <> ''").count() >= len(samples)
