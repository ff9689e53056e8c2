from datetime import UTC, datetime

import pytest
from stagelens.operators import alerts as L
from stagelens.operators import history as H
from stagelens.sources import schemas as S


def record(spark, run_id="r", day=1, log="a", duration=100.0, tasks=50, spill=0):
    row = (run_id, datetime(2024, 1, day, tzinfo=UTC), log, duration, 1000, 0, 0, spill, 1, 1, tasks, 0, 0.5, 10)
    return spark.createDataFrame([row], S.RUN_RECORD)


def test_round_trip_filter_and_last(spark, tmp_path):
    path = str(tmp_path / "history")
    assert H.read(spark, path).count() == 0
    for d in (3, 1, 2):
        H.append(record(spark, f"r{d}", d, "a" if d < 3 else "b"), path)
    assert [r.run_id for r in H.read(spark, path).collect()] == ["r1", "r2", "r3"]
    assert [r.run_id for r in H.read(spark, path, "a").collect()] == ["r1", "r2"]
    assert [r.run_id for r in H.read(spark, path, last_n=2).collect()] == ["r2", "r3"]


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="format"):
        H.append(record(spark), str(tmp_path / "x"), "xml")


def rule(**more):
    return L.AlertRule(**({"name": "n", "log_name": "a", "metric": "duration_s", "condition": "threshold", "threshold": 50.0} | more))


@pytest.mark.parametrize(
    ("rules", "past", "fired"),
    [
        (rule(), [], 1), (rule(threshold=100.0), [], 0), (rule(log_name="b"), [], 0), (rule(metric="nothing"), [], 0),
        (rule(condition="pct_increase", threshold=0.5), [50.0, 70.0], 1), (rule(condition="pct_increase", threshold=0.5), [90.0], 0), (rule(condition="pct_increase", threshold=0.5), [], 1),
        (rule(condition="absolute_increase", threshold=30.0), [60.0], 1), (rule(condition="absolute_increase", threshold=30.0), [80.0], 0), (rule(condition="pct_increase", threshold=0.5, window=1), [10.0, 90.0], 0),
    ],
)
def test_conditions(spark, rules, past, fired):
    now = record(spark, "now", 20)
    before = now
    for i, d in enumerate(past):
        before = before.unionByName(record(spark, f"p{i}", 1 + i, duration=d))
    assert len(L.check_rules(now, before, [rules])) == fired


def test_dispatch(spark, tmp_path):
    now, path = record(spark), str(tmp_path / "alerts.jsonl")
    L.check_rules(now, now, [rule(on_trigger="file")], path)
    assert '"name": "n"' in (tmp_path / "alerts.jsonl").read_text()
    with pytest.raises(L.AlertError) as e:
        L.check_rules(now, now, [rule(on_trigger="raise")])
    assert (e.value.metric, e.value.current, e.value.baseline) == ("duration_s", 100.0, 0.0)


def test_rules_from_toml(tmp_path):
    (tmp_path / "a.toml").write_text('[[alerts]]\nname = "n"\nlog_name = "a"\nmetric = "n_tasks"\ncondition = "threshold"\nthreshold = 1.0\n')
    (one,) = L.load_rules(str(tmp_path / "a.toml"))
    assert (one.window, one.severity, one.on_trigger) == (10, "warning", "log")
    with pytest.raises(ValueError, match="condition"):
        rule(condition="odd")
