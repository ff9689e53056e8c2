import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from stagelens import api, cli, render
from stagelens.operators import detect, history, telemetry
from stagelens.queries import own_log
from stagelens.sources import eventlog as E
from stagelens.sources import sinks, storage

WORK = """
import sys
from pyspark.sql import SparkSession, functions as F
from stagelens.session import event_log_conf
spark = SparkSession.builder.master("local[2]").config(map=event_log_conf(sys.argv[1])).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.autoBroadcastJoinThreshold", "-1").getOrCreate()
a = spark.read.parquet(sys.argv[2] + "/orders.parquet")
a.groupBy("o_orderstatus").count().collect()
b = a.select("o_custkey")
print(b.join(b.withColumnRenamed("o_custkey", "k"), F.col("o_custkey") == F.col("k")).count())
n = spark.read.parquet(sys.argv[2] + "/nation.parquet")
n.join(F.broadcast(n.select(F.col("n_name").alias("m"))), F.col("n_name") < F.col("m")).count()
spark.stop()
"""


@pytest.fixture(scope="module")
def log(tmp_path_factory, sf_dir):
    """A log of our own: an aggregation, a join that multiplies rows, and a nested loop."""
    folder = tmp_path_factory.mktemp("logs")
    out = subprocess.run([sys.executable, "-c", WORK, str(folder), sf_dir], capture_output=True, text=True, timeout=240, check=True)
    return folder, int(out.stdout.split()[-1])


@pytest.fixture(scope="module")
def relations(spark, log):
    r = api.relations(spark, E.latest(spark, str(log[0])))
    r.dag, r.combined = r.dag.persist(), r.combined.persist()
    return r


def test_relations(relations, log):
    assert relations.combined.count() > 0 and relations.dag.count() == relations.nodes.count()
    assert relations.combined.where("executor_run_time_seconds > task_duration_seconds + 0.01").count() == 0
    rows = [r.output for r in relations.dag.where("node_type = 'SortMergeJoin'").select(detect.output_rows().alias("output")).collect()]
    assert rows == [log[1]]  # the known number of rows


def test_known_findings(relations):
    kinds = {r.category for r in detect.issues(relations.dag, relations.combined).collect()}
    assert {"Row Count Explosion", "Cartesian Join", "Repeated Scan"} <= kinds
    assert "orders.parquet" in detect.find_repeated_scans(relations.dag).first().path


def test_summary_record_and_picture(relations):
    s = detect.summary(relations.dag, relations.combined, "x")
    assert set(s) == {"log_name", "queries", "totals"} and s["totals"]["records_read"] > 0
    assert any((n.get("details") or {}).get("join_type") == "Inner" for q in s["queries"] for n in q["nodes"])
    r = history.run_record(relations.dag, relations.combined, "x").first()
    assert r.n_queries == len(s["queries"]) and r.n_cartesian_joins == 1 and r.max_scan_bytes > 0
    page = render.plot_dag(relations.dag)
    assert page.count("<rect") > 3 and "http" not in page


def test_written_relations(spark, relations, tmp_path):
    for fmt in ("csv", "parquet", "json"):
        paths = sinks.write_relations(relations.dag, relations.combined, str(tmp_path), fmt, fmt)
        reader = spark.read.option("header", True).format(fmt).load(paths[1])
        assert reader.count() == relations.combined.count()
    with pytest.raises(ValueError, match="format"):
        sinks.write_table(relations.dag, str(tmp_path / "x"), "xml")


def test_catalogue(spark, log):
    (r,) = E.catalogue(spark, str(log[0])).collect()
    assert r.size_mb > 0 and r.started < r.completed and r.duration.endswith(("sec", "min"))


def line(event, **more):
    return json.dumps({"Event": event, **more})


def test_lines_before_the_start_and_other_events_are_passed_over(spark, tmp_path):
    text = [line("SparkListenerJobStart", **{"Job ID": 1}), line("SparkListenerApplicationStart"), line("SparkListenerJobStart", **{"Job ID": 2, "Submission Time": 5, "Stage IDs": [0, 1]}), line("SparkListenerStageExecutorMetrics", **{"Stage ID": 0}), "", line("SparkListenerJobEnd", **{"Job ID": 2, "Completion Time": 9})]
    (tmp_path / "app-1").write_text("\n".join(text))
    t = E.read(spark, str(tmp_path / "app-1"))
    assert [(r.job_id, r.event_type, r.job_timestamp, r.stages) for r in t.jobs.orderBy("job_timestamp").collect()] == [(2, "start", 5, [0, 1]), (2, "end", 9, None)]
    assert t.stages.count() == 0 and t.plans.count() == 0


def test_no_start_and_no_plan(spark, tmp_path):
    (tmp_path / "a").write_text(line("SparkListenerJobStart", **{"Job ID": 1}))
    with pytest.raises(ValueError, match="ApplicationStart"):
        E.read(spark, str(tmp_path / "a"))
    (tmp_path / "b").write_text(line("SparkListenerApplicationStart"))
    with pytest.raises(ValueError, match="No queries"):
        api.relations(spark, str(tmp_path / "b"))


def test_rolling_parts_keep_their_order(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app-7"
    folder.mkdir()
    (folder / "appstatus_app-7").write_text("")
    (folder / "events_2_app-7").write_text(line("org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates", executionId=0, accumUpdates=[[7, 2]]))
    (folder / "events_1_app-7").write_text("\n".join([line("SparkListenerApplicationStart"), line("org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates", executionId=0, accumUpdates=[[7, 1], [8, 5]])]))
    rows = E.after_start(E.lines(spark, str(folder)))
    got = E.driver_updates(rows).orderBy("place", "pos").collect()
    assert [(r.log_name, r.accumulator_id, r.update) for r in got] == [("app-7", 7, 1), ("app-7", 8, 5), ("app-7", 7, 2)]


def test_strict_functions(spark):
    rows = spark.createDataFrame([("x", 1, line("SparkListenerSQLExecutionStart", executionId=1, description="odd at x", time=1))], "log_name string, place long, value string").withColumn("event", E.event_of(F.col("value")))
    assert E.queries(rows).first().query_function is None
    with pytest.raises(Exception, match="Unknown query function"):
        E.queries(rows, strict=True).collect()


@pytest.mark.parametrize(("path", "cloud"), [("s3://b/x", True), ("abfss://c@a/x", True), ("gs://b", True), ("dbfs:/x", True), ("/dbfs/x", False), ("/Volumes/x", False), ("x/y", False)])
def test_cloud_paths(path, cloud):
    assert storage.is_cloud_path(path) is cloud


def test_local_files(tmp_path):
    p = str(tmp_path / "d" / "f.txt")
    storage.write_text(p, "a")
    storage.append_text(p, "b")
    assert storage.read_text(p) == "ab" and storage.path_exists(p) and storage.list_files(str(tmp_path / "d")) == [p]
    storage.copy_file(p, str(tmp_path / "e" / "g.tar.gz"))
    assert storage.path_stem(str(tmp_path / "e" / "g.tar.gz")) == "g.tar" and storage.path_name("s3://b/c/") == "c"
    assert storage.join_path("s3://b/", "c", "d") == "s3://b/c/d" and storage.resolve_dir("x", "/base") == "/base/x"
    storage.remove_dir(str(tmp_path / "d"))
    assert not storage.path_exists(p)


def test_lines_are_written_once_by_event(spark, log):
    t = E.read(spark, E.latest(spark, str(log[0])))
    plan = t.tasks._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "FileScan parquet" in plan and "FileScan text" not in plan and "PartitionFilters: [" in plan and "SparkListenerTaskEnd" in plan
    assert t.tasks.count() > 0


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_are_written_as_columns(spark, log):
    """JSON is parsed once, and neither lines nor keys are kept."""
    t = E.read(spark, E.latest(spark, str(log[0])))
    plan = optimized(t.tasks)
    assert "from_json" not in plan and "value#" not in plan
    rows = E.after_start(E.lines(spark, E.latest(spark, str(log[0]))))
    key = lambda r: r.task_id
    assert sorted(t.tasks.drop("place").collect(), key=key) == sorted(E.tasks(rows).drop("place").collect(), key=key)


def test_tasks_meet_plans_without_a_shuffle(spark, log):
    """The lists of a node's tasks are made only where they are asked for, and tasks are joined with small tables."""
    r = api.relations(spark, E.latest(spark, str(log[0])))
    assert "collect_list(struct(o" in optimized(r.dag) and optimized(r.dag.select("node_id", "n_accumulators")).count("collect_list(struct(o") == 0
    steps = r.combined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in steps and "SortMergeJoin" not in steps
    columns = ["log_name", "query_id", "stage_id", "task_id", "nodes"]
    want = {(*x[:4], tuple(x[4])) for x in telemetry.task_nodes(r.dag).select(*columns).collect()}
    got = [(*x[:4], tuple(x[4])) for x in r.combined.select(*columns).collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_a_driver_update_counts_for_a_task_without_a_number(spark):
    """As in the lists of dag: a null update of a task stands for its accumulator's update by the driver."""
    made = "array(named_struct('accumulator_id', 7L, 'update', cast(null AS bigint)), named_struct('accumulator_id', 8L, 'update', cast(null AS bigint)), named_struct('accumulator_id', 9L, 'update', 1L))"
    listed = "array(named_struct('node_id', 1L, 'node_name', 'a', 'accumulator_id', 7L, 'by_driver', true), named_struct('node_id', 2L, 'node_name', 'b', 'accumulator_id', 8L, 'by_driver', false), named_struct('node_id', 3L, 'node_name', 'c', 'accumulator_id', 9L, 'by_driver', false))"
    assert spark.sql(f"SELECT {made} AS accumulators, {listed} AS metrics").select(telemetry.ran_nodes().alias("n")).first().n == ["a", "c"]


def test_own_logs_are_small_and_go_when_they_are_read(spark, sf_dir):
    folder = own_log.written(spark, sf_dir).removeprefix("file://").removeprefix("file:")
    parts = [p for p in Path(folder).rglob("part-*") if "events_2" in str(p)]
    lines = spark.read.option("recursiveFileLookup", True).text(folder).count()
    assert all(p.name.endswith(".gz") for p in parts) and sum(p.stat().st_size for p in parts) < 80 * lines
    before = set(Path(folder).parent.glob("own-log-*"))
    assert own_log.log_events(spark, sf_dir).count() == 12
    assert set(Path(folder).parent.glob("own-log-*")) == before


@pytest.fixture()
def command(spark, monkeypatch, capsys):
    def run(*arguments):
        monkeypatch.setattr(cli, "_spark", lambda: spark)
        code = cli.main([str(a) for a in arguments])
        return code, capsys.readouterr().out

    return run


def test_get_writes_both_relations(spark, command, log, tmp_path):
    code, out = command("get", log[0], "--out-dir", tmp_path, "--out-name", "mine", "--out-format", "parquet")
    name = out.strip().splitlines()[-1]
    written = [p for p in tmp_path.rglob("*") if p.is_dir() and name in p.name]
    assert code == 0 and "mine" in name and len(written) == 2


def test_analyze_prints_the_summary_and_the_issues(command, log):
    code, out = command("analyze", log[0])
    summary = json.loads(out)
    assert code == 0 and {"log_name", "queries", "totals", "issues"} == set(summary)
    assert {"Row Count Explosion", "Cartesian Join"} <= {i["category"] for i in summary["issues"]}
    _, text = command("analyze", log[0], "--format", "text")
    assert "Totals" in text and "critical: Row Count Explosion: Inner join of" in text and "without join keys" in text


def test_viz_writes_a_page_with_the_issues(command, log, tmp_path):
    code, _ = command("viz", log[0], "--out-file", tmp_path / "p.html", "--dark")
    page = (tmp_path / "p.html").read_text()
    assert code == 0 and "<svg" in page and "Issues (" in page and "Row Count Explosion" in page


def test_history_and_alerts(spark, command, relations, tmp_path):
    path, rules, out_file = str(tmp_path / "runs"), tmp_path / "rules.toml", tmp_path / "alerts.jsonl"
    assert command("check-alerts", path, rules)[0] == 1  # no history yet
    for _ in range(2):
        history.append(history.run_record(relations.dag, relations.combined, "x"), path)
    code, out = command("history", path, "--format", "json", "--last-n", 1)
    assert code == 0 and len(json.loads(out)) == 1 and json.loads(out)[0]["log_name"] == "x"
    assert "tasks" in command("history", path)[1]
    rules.write_text(RULES)
    code, out = command("check-alerts", path, rules, "--alert-output", out_file)
    assert code == 0 and "many tasks" in out and "many tasks" in out_file.read_text()
    assert command("check-alerts", path, rules)[0] == 0  # a file alert without a path is logged, and no more


RULES = """
[[alerts]]
name = "many tasks"
log_name = "x"
metric = "n_tasks"
condition = "threshold"
threshold = 0
severity = "warning"
on_trigger = "file"
"""
