import subprocess
import sys

CODE = """
import sys, json
from stagelens.capture import capture, capture_context
from pyspark.sql import SparkSession
SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()

@capture(action="analyze", log_name="job", history_path=sys.argv[1])
def work(spark, n=10):
    return spark.range(n).groupBy("id").count().collect()

result, got = work()
assert len(result) == 10, result
assert got.relations.combined.count() > 0 and got.summary["queries"], got.summary
from stagelens.operators import history
assert history.read(got.spark, sys.argv[1]).count() == 1
with capture_context("viz", got.spark) as again:
    again.spark.range(5).groupBy("id").count().collect()
assert "<svg" in again.html
try:
    with capture_context("get", again.spark) as failed:
        raise KeyError("x")
except KeyError:
    assert failed.relations is None
print("captured")
"""


def test_capture(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE, str(tmp_path / "history")], capture_output=True, text=True, timeout=300)
    assert "captured" in out.stdout, out.stderr[-3000:]


def test_command_line_has_its_commands():
    from stagelens.cli import parser

    p = parser()
    assert p.parse_args(["get", "logs", "--out-format", "parquet"]).out_format == "parquet"
    assert p.parse_args(["check-alerts", "h", "c"]).run.__name__ == "_check_alerts"
