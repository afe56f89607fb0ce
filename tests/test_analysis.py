from datetime import timedelta

from duskwatch.operators.export import alert_records
from duskwatch.operators.features import extract_features
from duskwatch.operators.iforest import fit
from duskwatch.operators.rules import brute_force, user_probing
from duskwatch.operators.summaries import hourly_intensity
from duskwatch.plans.analysis import analyze
from duskwatch.scratch import CHECKPOINT_DIR, materialize, scratch_folder

from .helpers import NOW, write_log

LINE = "Nov 03 21:07:{:02d} birch sshd[{}]: Failed password for wen from 10.9.8.7"


def test_burst_of_failures(spark, tmp_path):
    text = "\n".join(LINE.format(i, 100 + i) for i in range(9))
    result = analyze(spark, write_log(tmp_path, "auth.log", text), NOW)
    alerts = result.alerts.collect()
    assert [a.datetime.second for a in alerts] == [5, 6, 7, 8]
    assert {a.ip_origen for a in alerts} == {"10.9.8.7"}
    assert result.total_logs == 9 and result.total_anomalies == 4
    (stats,) = result.stats.collect()
    assert (stats.lines_read, stats.lines_parsed, stats.parse_rate) == (9, 9, 100.0)
    assert result.metadata["rules_active"][0] == "Brute Force"
    assert result.metadata["latency_ms"] > 0


def test_five_failures_are_no_alert(spark, tmp_path):
    text = "\n".join(LINE.format(i, 100 + i) for i in range(5))
    assert analyze(spark, write_log(tmp_path, "auth.log", text), NOW).total_anomalies == 0


def test_garbage_gives_statistics_but_no_alerts(spark, tmp_path):
    path = write_log(tmp_path, "x.log", "milk, eggs\nand a new lamp")
    result = analyze(spark, path, NOW)
    assert (result.total_logs, result.total_anomalies) == (0, 0)
    assert result.stats.first().lines_discarded == 2


def test_events_can_be_kept(spark, tmp_path):
    path = write_log(tmp_path, "auth.log", LINE.format(1, 1))
    kept = str(tmp_path / "events")
    analyze(spark, path, NOW, rules=[brute_force()], formats="syslog", events_path=kept)
    assert spark.read.parquet(kept).count() == 1


def test_model_joins_the_rules(spark, tmp_path):
    text = "\n".join(
        f"Oct 15 1{i % 8}:30:{i % 60:02d} server sshd[1]: Accepted password for u{i % 3} from 192.0.2.{i % 9}"
        for i in range(200)
    )
    path = write_log(tmp_path, "auth.log", text)
    forest = fit(extract_features(analyze(spark, path, NOW).events), contamination=0.1)
    result = analyze(spark, path, NOW, rules=[], model=forest)
    assert result.metadata["rules_active"] == ["Isolation Forest Anomaly"]
    assert 0 < result.total_anomalies <= 20


def test_scratch_tables_go_to_the_shared_folder(spark):
    class Session:
        def __init__(self, folder):
            self.conf = {CHECKPOINT_DIR: folder}
            self.sparkContext = spark.sparkContext

    assert scratch_folder(Session("hdfs://shared/")).startswith("hdfs://shared/")
    assert scratch_folder(Session("hdfs://shared")) != scratch_folder(Session("hdfs://shared"))
    assert materialize(spark.range(3)).count() == 3
    own = {scratch_folder(spark).rsplit("/", 1)[0] for _ in range(2)}
    assert len(own) == 1


def test_order_of_time(spark, tmp_path):
    text = "\n".join(LINE.format(59 - i, i) for i in range(20))
    rows = analyze(spark, write_log(tmp_path, "auth.log", text), NOW).alerts.collect()
    times = [r.datetime for r in rows]
    assert times == sorted(times) and times[-1] - times[0] < timedelta(minutes=1)


def test_wall_clock_times_in_any_session_time_zone(spark, tmp_path):
    """02:30 does not exist on that day in New York, but a log may hold it."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamps = [f"Mar  8 0{h}:{m}:{s:02d}" for h, m, s0 in ((1, 59, 58), (2, 30, 0)) for s in range(s0, s0 + 2)]
        text = "\n".join(
            f"{stamp} h sshd[1]: Failed password for u{i} from 192.0.2.1" for i, stamp in enumerate(stamps)
        )
        path = write_log(tmp_path, "dst.log", text)
        result = analyze(spark, path, NOW, rules=[user_probing(4, 1900)])
        (record,) = alert_records(result.alerts).collect()
        assert record.datetime == "2026-03-08 02:30:01"
        # half an hour lies between them on the wall clock
        assert analyze(spark, path, NOW, rules=[user_probing(4, 1700)]).total_anomalies == 0
        hours = [r.datetime.hour for r in hourly_intensity(result.events).orderBy("datetime").collect()]
        assert hours == [1, 2]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def text_scans(spark, since):
    """How often stages run after ``since`` read text files."""
    store = spark.sparkContext._jsc.sc().statusStore()
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    found = 0
    for i in range(runs.size()):
        run = runs.apply(i)
        if run.executionId() > since:
            found += run.physicalPlanDescription().count("Scan text")
    assert store is not None
    return found


def last_run(spark):
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max((runs.apply(i).executionId() for i in range(runs.size())), default=-1)


def test_the_text_is_read_once(spark, tmp_path):
    path = write_log(tmp_path, "auth.log", "\n".join(LINE.format(i, i) for i in range(30)))
    since = last_run(spark)
    result = analyze(spark, path, NOW)
    result.stats.collect()
    result.alerts.collect()
    assert result.total_logs == 30 and result.total_anomalies == 25
    # the plan of the one write that reads text names the scan in its tree and in its details
    assert text_scans(spark, since) <= 2


def test_missing_paths_are_named(spark, tmp_path):
    good, gone = write_log(tmp_path, "auth.log", LINE.format(1, 1)), str(tmp_path / "gone.log")
    result = analyze(spark, [gone, good], NOW)
    assert result.metadata["missing_paths"] == [gone] and result.total_logs == 1
