from datetime import datetime, timedelta
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskwatch.operators import features, iforest
from duskwatch.operators.features import FEATURES, extract_features
from duskwatch.operators.iforest import exact_quantile, fit, isolation_forest_rule, score
from duskwatch.scratch import materialize

from .helpers import frame, login_rows

BASE = datetime(2026, 10, 11, 10, 0, 0)


def features_of(spark, rows, columns=None):
    return extract_features(frame(spark, rows, columns)).orderBy("line_no").collect()


def at(status, ip="10.7.0.1", minutes=0, **more):
    return {"datetime": BASE + timedelta(minutes=minutes), "ip_origen": ip, "status": status, **more}


def test_feature_columns_and_absent_inputs(spark):
    df = extract_features(frame(spark, [at("SUCCESS")], ["datetime", "ip_origen", "status"]))
    assert df.columns[-8:] == FEATURES
    (row,) = df.collect()
    assert (row.unique_users_per_ip, row.unique_urls_per_ip, row.url_entropy) == (0, 0, 0.0)
    assert (row.hour, row.requests_per_minute) == (10, 1)


def test_status_values(spark):
    rows = features_of(spark, [at(s) for s in ("SUCCESS", "FAIL", "INFO", "UNKNOWN")])
    assert [r.status_val for r in rows] == [1.0, 0.0, 0.5, 0.5]


def test_address_hash(spark):
    a, b, c = features_of(spark, [at("FAIL", "10.7.0.1"), at("FAIL", "10.7.0.1"), at("FAIL", "10.7.0.2")])
    assert a.ip_encoded == b.ip_encoded != c.ip_encoded


def test_fail_ratio_needs_five_rows(spark):
    rows = [at(s) for s in ["SUCCESS", "FAIL", "SUCCESS", "FAIL", "SUCCESS"]]
    rows += [at(s, "10.7.0.2") for s in ["FAIL", "FAIL", "FAIL", "FAIL", "SUCCESS"]]
    rows += [at("FAIL", "10.7.0.3")] * 4
    got = [r.fail_ratio_per_ip for r in features_of(spark, rows)]
    assert got == [0.4] * 5 + [0.8] * 5 + [0.0] * 4


def test_distinct_users_and_urls(spark):
    rows = [at("FAIL", usuario=u, url=w, accion=None) for u, w in [("a", "/x"), ("b", None), (None, "/x")]]
    for r in features_of(spark, rows):
        assert (r.unique_users_per_ip, r.unique_urls_per_ip) == (2, 1)
        assert r.url_entropy == pytest.approx(2.0)  # a missing action counts as 'None'


def normal_rows(n=400):
    rng = np.random.default_rng(11)
    return [
        {
            "datetime": datetime(2026, 5, 6, 9, 0) + timedelta(minutes=int(m)),
            "ip_origen": f"10.7.{i % 8}.{i % 6}",
            "usuario": f"clerk{i % 3}",
            "accion": "read a page",
            "status": "SUCCESS",
        }
        for i, m in enumerate(rng.integers(0, 480, n))
    ]


ATTACK = login_rows(datetime(2026, 5, 6, 2, 30), 12, "172.20.1.1", "clerk0", "zq!7 wrong key #9", "FAIL", 3)


def test_planted_outliers_score_highest(spark):
    df = extract_features(frame(spark, normal_rows() + ATTACK)).cache()
    forest = fit(df, contamination=0.05)
    ranked = score(df, forest).orderBy(F.desc("score")).limit(12).collect()
    assert {r.line_no for r in ranked} == set(range(400, 412))
    assert all(0 < r.score < 1 for r in ranked)


def test_flagged_share_is_the_contamination(spark):
    df = extract_features(frame(spark, normal_rows())).cache()
    forest = fit(df, contamination=0.1)
    flagged = score(df, forest).where(iforest.is_outlier(forest)).count()
    assert 0 < flagged <= 40


def test_same_forest_whatever_the_partitioning(spark):
    df = extract_features(frame(spark, normal_rows()))
    one = fit(df.coalesce(1)).nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    many = fit(df.repartition(7)).nodes.sort_values(["tree", "node"]).reset_index(drop=True)
    assert one.equals(many)
    assert one["tree"].nunique() == 100
    assert len(one) <= 100 * (2 * 256 - 1)


def test_each_tree_gets_its_full_sample(spark):
    df = extract_features(frame(spark, normal_rows(300)))
    counts = iforest.tree_samples(df, ["line_no"], FEATURES, 20, 64, 1).groupBy("tree").count()
    assert [r["count"] for r in counts.collect()] == [64] * 20


def test_the_draw_does_not_depend_on_how_many_rows_are_looked_at(spark, monkeypatch):
    df = extract_features(frame(spark, normal_rows(300))).cache()
    draws = []
    for spare in (1, 4, 1000):
        monkeypatch.setattr(iforest, "SPARE", spare)
        rows = iforest.tree_samples(df, ["line_no"], FEATURES, 20, 8, 1).orderBy("tree", "place").collect()
        draws.append([(r["tree"], r["place"], tuple(r["x"])) for r in rows])
    assert draws[0] == draws[1] == draws[2]
    assert len(draws[0]) == 160


def test_rule_flags_unseen_behaviour(spark):
    forest = fit(extract_features(frame(spark, normal_rows())), contamination=0.05)
    found = isolation_forest_rule(forest).evaluate(frame(spark, ATTACK)).collect()
    assert found
    assert {(r.reason, r.severity) for r in found} == {("Isolation Forest Anomaly", "low")}


def test_rule_needs_a_model_and_five_rows(spark):
    forest = fit(extract_features(frame(spark, normal_rows(50))))
    assert isolation_forest_rule(forest).evaluate(frame(spark, ATTACK[:4])).count() == 0
    assert isolation_forest_rule(None).evaluate(frame(spark, ATTACK)).count() == 0


def test_save_and_load(spark, tmp_path):
    df = extract_features(frame(spark, normal_rows(100)))
    forest = fit(df)
    iforest.save_forest(spark, forest, str(tmp_path / "model"))
    again = iforest.load_forest(spark, str(tmp_path / "model"))
    assert (again.features, again.sample, again.cutoff) == (forest.features, 100, forest.cutoff)
    a = {r.line_no: r.score for r in score(df, forest).collect()}
    assert a == {r.line_no: r.score for r in score(df, again).collect()}


@pytest.mark.parametrize("q", [0.0, 0.01, 0.5, 0.9, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.random(500), np.full(300, 0.25), 0.25 + rng.random(200) * 1e-9])
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    assert exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(values, q)), abs=1e-15)


def test_average_path_values():
    assert list(iforest.average_path(np.array([0, 1, 2]))) == [0.0, 0.0, 1.0]
    assert float(iforest.average_path(256)) == pytest.approx(10.2448, abs=1e-3)


def test_trees_draw_independently(spark):
    """Any two trees share as many rows as two random draws: 256 * 256 / 1000."""
    df = spark.range(1000).selectExpr("id AS line_no", *[f"double(id * {i + 1}) AS {c}" for i, c in enumerate(FEATURES)])
    drawn = {}
    for r in iforest.tree_samples(df, ["line_no"], FEATURES, 60, 256, 7).collect():
        drawn.setdefault(r["tree"], set()).add(r["x"][0])
    assert all(len(v) == 256 for v in drawn.values())
    for apart in (1, 2, 7, 30):
        shared = [len(drawn[t] & drawn[(t + apart) % 60]) / 256 for t in range(60)]
        assert abs(np.mean(shared) - 0.256) < 0.02 and max(shared) < 0.40
    often = np.bincount([int(v) for rows in drawn.values() for v in rows], minlength=1000)
    assert abs(often.mean() - 60 * 0.256) < 1e-9 and often.std() < 1.3 * np.sqrt(60 * 0.256 * 0.744)


@pytest.mark.parametrize("q", [0.0, 0.37, 0.5, 0.99, 1.0])
def test_the_quantile_of_many_values_takes_three_passes(spark, monkeypatch, q):
    monkeypatch.setattr(iforest, "FEW", 400)
    monkeypatch.setattr(iforest, "SKETCH", 2000)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(30_000), rng.normal(0.5, 1e-6, 10_000)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3).cache()
    passes = []
    kind = type(df)
    group = kind.groupBy  # agg() calls it as well
    monkeypatch.setattr(kind, "groupBy", lambda self, *a: passes.append(1) or group(self, *a))
    got = exact_quantile(df, "v", q)
    monkeypatch.undo()
    assert got == pytest.approx(float(np.quantile(values, q)), abs=1e-15)
    assert got == pytest.approx(df.selectExpr(f"percentile(v, {q})").first()[0], abs=1e-15)
    assert len(passes) <= 3


@pytest.mark.parametrize("q", [0.1, 0.3, 0.30001, 0.5, 0.65, 0.9])
def test_the_quantile_among_heavy_ties(spark, monkeypatch, q):
    monkeypatch.setattr(iforest, "FEW", 50)
    values = np.concatenate([np.full(3000, 1.0), np.linspace(1.5, 1.6, 500), np.full(3000, 2.0), np.full(3500, 3.0)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(values, q)), abs=1e-15)


def test_a_hot_address_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(features, "FAIR_SHARES", 20)
    rows = [
        {"datetime": datetime(2026, 5, 6, 9) + timedelta(seconds=i), "ip_origen": "0.0.0.0" if i % 3 == 0 else f"10.0.{i % 40}.1", "usuario": f"u{i % 9}", "status": "FAIL" if i % 2 else "SUCCESS", "url": f"/{i}"}
        for i in range(3000)
    ]
    events = frame(spark, rows)
    sources = materialize(features.per_source(events, _rows=F.count(F.lit(1))))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = features.with_source(events.select("file_path", "block", "line_no", "ip_origen"), sources)
        each = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(each) == 3000 and max(each) < 5 * 3000 / 20
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    got = {r["line_no"]: r for r in extract_features(events).collect()}
    assert len(got) == 3000 and {r["unique_urls_per_ip"] for i, r in got.items() if i % 3 == 0} == {1000}
    assert {r["fail_ratio_per_ip"] for i, r in got.items() if i % 3 == 0} == {0.5}


def test_columns_that_pass_through_are_shuffled_only_if_used(spark):
    rows = [at("FAIL", usuario="u", url=f"/{i}", user_agent="a") for i in range(9)]
    kept = extract_features(frame(spark, rows), keep=["usuario", "user_agent"])
    assert {(r.usuario, r.user_agent) for r in kept.collect()} == {("u", "a")}
    plan = kept.select("line_no", "usuario")._jdf.queryExecution().optimizedPlan().toString()
    assert "_kept_usuario" in plan and "_kept_user_agent" not in plan


def test_the_rule_query_parses_its_events_once(spark, tmp_path, monkeypatch):
    from verification import registry

    calls = []
    real = registry.L.all_events
    monkeypatch.setattr(registry.L, "all_events", lambda *a: calls.append(a) or real(*a))
    spark.range(200).selectExpr(
        "id AS event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id * 40) AS ts", "id % 7 AS user_id",
        "element_at(array('error', 'signup', 'click', 'view', 'purchase'), int(id % 5) + 1) AS event_type",
    ).write.parquet(f"{tmp_path}/events.parquet")
    registry.QUERIES["rule_iforest"](spark, str(tmp_path)).collect()
    assert len(calls) == 1
