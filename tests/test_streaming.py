import json

from stagelens.streaming.tail import into_table, tail


def line(event, **more):
    return json.dumps({"Event": event, **more})


def test_lines_come_once(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    logs.mkdir()
    (logs / "app-1").write_text("\n".join([line("SparkListenerApplicationStart", Timestamp=1_700_000_000_000), line("SparkListenerJobStart", **{"Job ID": 1, "Submission Time": 1_700_000_001_000})]))
    into_table(tail(spark, str(logs)), out, state).awaitTermination()
    (logs / "app-2").write_text(line("org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart", executionId=1, time=1_700_000_002_000))
    into_table(tail(spark, str(logs)), out, state).awaitTermination()
    rows = spark.read.parquet(out).orderBy("ts").collect()
    assert [(r.log_name, r.event, r.ts.second) for r in rows] == [("app-1", "SparkListenerApplicationStart", 20), ("app-1", "SparkListenerJobStart", 21), ("app-2", "SparkListenerSQLExecutionStart", 22)]
