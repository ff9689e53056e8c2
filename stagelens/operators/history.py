"""Records of runs: one row a run, appended to a table, read back by log."""

from __future__ import annotations

import importlib.util
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import schemas as S
from .detect import cartesian_joins, find_largest_scans


def run_record(dag: DataFrame, combined: DataFrame, log_name: str, run_id: str | None = None, run_at: datetime | None = None) -> DataFrame:
    """One row of S.RUN_RECORD: from the first query's start to the last one's end, and sums over tasks. Null
    queries and stages count as one value each."""
    distinct = lambda c: (F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).cast("long")
    time = lambda c: F.to_timestamp(c, "yyyy-MM-dd'T'HH:mm:ss")
    queries = dag.agg((F.unix_millis(F.max(time("query_end_timestamp"))) - F.unix_millis(F.min(time("query_start_timestamp")))).alias("ms"), F.max("node_duration_minutes").alias("max_node_duration_min"))
    tasks = combined.agg(
        F.sum("bytes_read").alias("bytes_read"), F.sum("bytes_written").alias("bytes_written"), F.sum(F.col("shuffle_bytes_read") + F.col("shuffle_bytes_written")).alias("shuffle_bytes"),
        F.sum(F.col("memory_bytes_spilled") + F.col("disk_bytes_spilled")).alias("spill_bytes"), distinct("query_id").alias("n_queries"), distinct("stage_id").alias("n_stages"), F.count("*").alias("n_tasks"),
    )
    cartesian = cartesian_joins(dag).agg(F.count("*").alias("n_cartesian_joins"))
    largest = find_largest_scans(dag, combined, 1).agg(F.max("bytes_read").alias("max_scan_bytes"))
    one = queries.crossJoin(tasks).crossJoin(cartesian).crossJoin(largest)  # a row each
    counts = ("bytes_read", "bytes_written", "shuffle_bytes", "spill_bytes", "n_queries", "n_stages", "n_tasks", "n_cartesian_joins", "max_scan_bytes")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts}
    one = one.withColumns(zero | {"duration_s": F.coalesce(F.col("ms") / F.lit(1000.0), F.lit(0.0)), "max_node_duration_min": F.coalesce("max_node_duration_min", F.lit(0.0)), "run_id": F.lit(run_id or uuid.uuid4().hex), "run_at": F.lit(run_at or datetime.now(UTC)).cast("timestamp"), "log_name": F.lit(log_name)})
    return one.select(*(f.split()[0] for f in S.RUN_RECORD.split(", ")))


def _format(path: str, wanted: str) -> str:
    if wanted not in ("auto", "json", "jsonl", "parquet", "delta"):
        raise ValueError(f"Unknown history format: {wanted}")
    if wanted == "auto":
        return "delta" if importlib.util.find_spec("delta") and not path.endswith(".jsonl") else "json"
    return "json" if wanted == "jsonl" else wanted


def append(record: DataFrame, path: str, fmt: str = "auto") -> None:
    """Adds a record to the history: a folder of JSON lines, or a Delta table where that can be imported."""
    kind = _format(path, fmt)
    writer = record.coalesce(1).write.mode("append").format(kind)
    (writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if kind == "json" else writer).save(path)


def read(spark: SparkSession, path: str, log_name: str | None = None, last_n: int | None = None, fmt: str = "auto") -> DataFrame:
    """Records by time, oldest first; the last_n newest of them; none where there is no history yet."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], S.RUN_RECORD)
    kind = _format(path, fmt)
    rows = spark.read.format(kind) if kind == "delta" else spark.read.format(kind).schema(S.RUN_RECORD)
    rows = rows.load(path)
    if log_name is not None:
        rows = rows.where(F.col("log_name") == log_name)
    return last_runs(rows, last_n).orderBy("run_at") if last_n is not None else rows.orderBy("run_at")


def last_runs(runs: DataFrame, n: int, by_log: bool = False) -> DataFrame:
    """The n newest runs, of all or of each log."""
    if not by_log:
        return runs.orderBy(F.desc("run_at"), F.desc("run_id")).limit(n)
    w = Window.partitionBy("log_name").orderBy(F.desc("run_at"), F.desc("run_id"))
    return runs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
