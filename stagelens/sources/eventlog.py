"""Spark event logs as DataFrames: lines, then one table for each kind of event.

Lines are written once by event, and every table reads its own; those of finished tasks, nearly all of a log, as columns. A line keeps its place (part, block,
row), by which events are ordered; plain files are split over tasks, and of rolling logs the parts count in their order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .shared import kept, new_folder

START, TASK_END = "SparkListenerApplicationStart", "SparkListenerTaskEnd"


@dataclass
class EventTables:
    """The tables of one or more logs."""

    jobs: DataFrame
    stages: DataFrame
    tasks: DataFrame
    queries: DataFrame
    plans: DataFrame
    driver_updates: DataFrame


def log_name_of(path: Column) -> Column:
    """The log that a file belongs to: the folder of a rolling log, else the file's name."""
    rolling = F.regexp_extract(path, r"eventlog_v2_([^/]+)/", 1)
    return F.when(rolling != "", rolling).otherwise(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.(zstd|lz4|snappy|gz|json|inprogress)$", ""))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(log_name, place, event, value) of each line of the logs at the path: files, folders, rolling folders."""
    plain = spark.read.option("recursiveFileLookup", True).text(path).where(~F.col("_metadata.file_name").startswith("appstatus"))
    file = F.col("_metadata.file_path")
    part = F.coalesce(F.regexp_extract(file, r"/events_(\d+)_", 1).try_cast("int"), F.lit(0))
    rows = plain.select(log_name_of(file).alias("log_name"), F.struct(part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"), "value")
    return rows.where("trim(value) <> ''").withColumn("event", event_of(F.col("value")))


def event_of(value: Column) -> Column:
    """The event's name without its package. Spark writes it first; other orders are read as JSON."""
    first = F.regexp_extract(value, r'^\s*\{\s*"Event"\s*:\s*"([^"]+)"', 1)
    return F.element_at(F.split(F.when(first != "", first).otherwise(F.get_json_object(value, "$.Event")), r"\."), -1)


def starts(rows: DataFrame) -> DataFrame:
    """(log_name, begin): where each log's application starts."""
    return rows.where(F.col("event") == START).groupBy("log_name").agg(F.min("place").alias("begin"))


def after_start(rows: DataFrame, begin: DataFrame | None = None) -> DataFrame:
    """Lines after each log's application start, by starts() where they are known; a log without one has none."""
    return rows.join(starts(rows) if begin is None else begin, "log_name").where("place > begin").drop("begin")


def require_start(rows: DataFrame) -> None:
    """Raises ValueError where no log has an application start."""
    if rows.where(F.col("event") == START).limit(1).isEmpty():
        raise ValueError(f"Could not find '{START}' event in the log")


def _of(rows: DataFrame, events: tuple[str, ...], schema: str) -> DataFrame:
    """The lines of some events, parsed. The name is compared before any JSON is."""
    return rows.where(F.col("event").isin(*events)).select("log_name", "place", "event", F.from_json("value", schema).alias("e"))


def jobs(rows: DataFrame) -> DataFrame:
    e = _of(rows, ("SparkListenerJobStart", "SparkListenerJobEnd"), S.JOB)
    start = F.col("event") == "SparkListenerJobStart"
    return e.select("log_name", F.col("e.Job ID").alias("job_id"), F.when(start, "start").otherwise("end").alias("event_type"), F.when(start, F.col("e.Submission Time")).otherwise(F.col("e.Completion Time")).alias("job_timestamp"), F.when(start, F.col("e.Stage IDs")).alias("stages"))


def stages(rows: DataFrame) -> DataFrame:
    e = _of(rows, ("SparkListenerStageSubmitted", "SparkListenerStageCompleted"), S.STAGE)
    start = F.col("event") == "SparkListenerStageSubmitted"
    info = lambda name: F.col(f"e.Stage Info.{name}")
    return e.select("log_name", info("Stage ID").alias("stage_id"), info("Stage Attempt ID").alias("stage_attempt_id"), F.when(start, "start").otherwise("end").alias("event_type"), F.when(start, info("Submission Time")).otherwise(info("Completion Time")).alias("stage_timestamp"))


def tasks(rows: DataFrame) -> DataFrame:
    """A row a finished task: what it was, its metrics flat, and its accumulables as structs."""
    e = _of(rows, (TASK_END,), S.TASK_END)
    info, metrics = "e.Task Info.", "e.Task Metrics."

    def flat(prefix: str, pairs: list[tuple[str, str]]) -> list[Column]:
        return [F.col(f"{prefix}{key}").alias(name) for key, name in pairs]

    accumulators = F.transform(
        F.col(f"{info}Accumulables"),
        lambda a: F.struct(a["ID"].alias("accumulator_id"), a["Name"].alias("name"), a["Update"].try_cast("bigint").alias("update"), a["Value"].try_cast("bigint").alias("value"), a["Internal"].alias("internal"), a["Count Failed Values"].alias("count_failed_values"), a["Metadata"].alias("metadata")),
    )
    return e.select(
        "log_name", "place", F.col(f"{info}Task ID").alias("task_id"), F.col("e.Stage ID").alias("stage_id"), F.coalesce("e.Stage Attempt ID", F.lit(0)).alias("stage_attempt_id"), F.col(f"{info}Index").alias("index"), F.col(f"{info}Attempt").alias("attempt"),
        F.col(f"{info}Launch Time").alias("task_start_time"), F.col(f"{info}Finish Time").alias("task_finish_time"), F.col(f"{info}Executor ID").alias("executor_id"), F.col(f"{info}Host").alias("host"), F.col("e.Task Type").alias("task_type"),
        F.col(f"{info}Locality").alias("task_loc"), F.col(f"{info}Speculative").alias("speculative"), F.col(f"{info}Failed").alias("failed"), F.col(f"{info}Killed").alias("killed"),
        *flat(metrics, S.TASK), *flat(f"{metrics}Shuffle Read Metrics.", S.SHUFFLE_READ), *flat(f"{metrics}Shuffle Read Metrics.Push Based Shuffle.", S.PUSH), *flat(f"{metrics}Shuffle Write Metrics.", S.SHUFFLE_WRITE),
        *flat(f"{metrics}Input Metrics.", S.INPUT), *flat(f"{metrics}Output Metrics.", S.OUTPUT), *flat("e.Task Executor Metrics.", S.EXECUTOR), accumulators.alias("accumulators"),
    )


def query_function(description: Column) -> Column:
    """The first word of a description if it names a function, else null."""
    word = F.split(description, " ")[0]
    return F.when(word.isin(*S.QUERY_FUNCTIONS), word)


def queries(rows: DataFrame, strict: bool = False) -> DataFrame:
    """Starts and ends of queries; strict raises, when it runs, on a start whose function is unknown."""
    e = _of(rows, ("SparkListenerSQLExecutionStart", "SparkListenerSQLExecutionEnd"), S.QUERY)
    start = F.col("event") == "SparkListenerSQLExecutionStart"
    function = query_function(F.col("e.description"))
    if strict:
        function = F.when(start & function.isNull(), F.raise_error(F.concat(F.lit("Unknown query function: "), F.coalesce(F.split("e.description", " ")[0], F.lit("null")))).cast("string")).otherwise(function)
    return e.select("log_name", F.col("e.executionId").alias("query_id"), F.when(start, "start").otherwise("end").alias("event_type"), F.col("e.time").alias("query_time"), F.when(start, function).alias("query_function"))


def plans(rows: DataFrame, fallback: bool = False) -> DataFrame:
    """(log_name, query_id, plan, info, is_final): the last final plan of each query. With fallback, queries that
    have none, as those that aren't adaptive, come with the plan that they started with."""
    update = rows.where((F.col("event") == "SparkListenerSQLAdaptiveExecutionUpdate") & F.col("value").contains("isFinalPlan=true"))
    parsed = update.select("log_name", "place", F.from_json("value", "executionId bigint, physicalPlanDescription string, sparkPlanInfo string").alias("e"))
    parsed = parsed.where(F.get_json_object("e.sparkPlanInfo", "$.simpleString").endswith("isFinalPlan=true")).withColumn("is_final", F.lit(True))
    if fallback:
        start = rows.where(F.col("event") == "SparkListenerSQLExecutionStart").select("log_name", "place", F.from_json("value", "executionId bigint, physicalPlanDescription string, sparkPlanInfo string").alias("e"), F.lit(False).alias("is_final"))
        parsed = parsed.unionByName(start)
    last = parsed.groupBy("log_name", F.col("e.executionId").alias("query_id")).agg(F.max_by(F.struct("e.physicalPlanDescription", "e.sparkPlanInfo", "is_final"), F.struct("is_final", "place")).alias("p"))
    return last.select("log_name", "query_id", F.col("p.physicalPlanDescription").alias("plan"), F.col("p.sparkPlanInfo").alias("info"), F.col("p.is_final").alias("is_final"))


def driver_updates(rows: DataFrame) -> DataFrame:
    e = _of(rows, ("SparkListenerDriverAccumUpdates",), S.DRIVER)
    each = e.select("log_name", "place", F.col("e.executionId").alias("query_id"), F.posexplode("e.accumUpdates").alias("pos", "u"))
    return each.select("log_name", "place", "pos", "query_id", F.col("u")[0].alias("accumulator_id"), F.col("u")[1].alias("update"))


#: Events that the tables are made of.
USED = (
    "SparkListenerJobStart", "SparkListenerJobEnd", "SparkListenerStageSubmitted", "SparkListenerStageCompleted", TASK_END, "SparkListenerSQLExecutionStart", "SparkListenerSQLExecutionEnd",
    "SparkListenerSQLAdaptiveExecutionUpdate", "SparkListenerDriverAccumUpdates",
)


def by_event(rows: DataFrame, folder: str) -> DataFrame:
    """Writes lines to a folder, by event, and reads them from there: each table then reads its own events and not the
    logs again."""
    rows.write.partitionBy("event").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder).select(*rows.columns)


def task_columns(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the table of finished tasks to a folder and reads it from there: its JSON is parsed once, and neither
    lines nor keys are kept. Written straight to its event's folder, as dealing rows to several would sort them."""
    table = tasks(rows)
    table.write.option("compression", "zstd").parquet(f"{folder}/event={TASK_END}")
    read = rows.sparkSession.read.schema(table.withColumn("event", F.lit("")).schema).parquet(folder)
    return read.where(F.col("event") == TASK_END).select(*table.columns)


def read(spark: SparkSession, path: str | list[str], strict: bool = False, fallback: bool = False) -> EventTables:
    """All tables of the logs at a path. Raises ValueError where nothing starts an application. The logs are read
    twice, for their tasks and for all else; every table reads what was written. Starts and lines are apart from the
    tasks, so that Spark knows how small they are."""
    every, folder = lines(spark, path), new_folder(spark, "events")
    found = by_event(every.where(F.col("event").isin(START, *(e for e in USED if e != TASK_END))), f"{folder}/found")
    require_start(found)
    begin = kept(starts(found), "starts")
    rows = by_event(after_start(found, begin).where(F.col("event") != START), f"{folder}/lines")
    ended = task_columns(after_start(every.where(F.col("event") == TASK_END), begin), f"{folder}/tasks")
    return EventTables(jobs(rows), stages(rows), ended, queries(rows, strict), plans(rows, fallback), driver_updates(rows))


def has_queries(rows: DataFrame) -> DataFrame:
    """(log_name, has_queries): whether any line of a log starts a query."""
    return rows.groupBy("log_name").agg(F.max(F.col("event") == "SparkListenerSQLExecutionStart").alias("has_queries"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Logs with queries, newest first: name, size_mb, started, completed, duration, days_old."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    meta = text.select(log_name_of(F.col("_metadata.file_path")).alias("log_name"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"), F.get_json_object("value", "$.Timestamp").cast("bigint").alias("ts"), F.col("value").contains("SparkListenerSQLExecutionStart").alias("q"))
    files = meta.groupBy("log_name", "file", "size", "changed").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("q").alias("q"))
    logs = files.groupBy("log_name").agg(F.sum("size").alias("size"), F.max("changed").alias("changed"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("q").alias("q")).where("q")
    return logs.select("log_name", F.round(F.col("size") / 1e6, 2).alias("size_mb"), F.timestamp_millis("first").alias("started"), F.timestamp_millis("last").alias("completed"), log_duration(F.col("first"), F.col("last")).alias("duration"), F.datediff(F.current_timestamp(), "changed").alias("days_old")).orderBy(F.desc("started"))


def log_duration(first: Column, last: Column) -> Column:
    """Time between two epoch milliseconds in sec, min, hr or days."""
    s = (last - first) / F.lit(1000.0)

    def say(value: Column, unit: str) -> Column:
        return F.concat(F.round(value.cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string"), F.lit(f" {unit}"))

    return F.when(s < 60, say(s, "sec")).when(s < 3600, say(s / 60.0, "min")).when(s < 86400, say(s / 3600.0, "hr")).otherwise(say(s / 86400.0, "days"))


def latest(spark: SparkSession, folder: str) -> str:
    """The log of a folder that is last by name."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().toString() for x in system.listStatus(fs_path) if not x.getPath().getName().startswith("."))
    if not names:
        raise ValueError(f"No log files found in: {folder}")
    return names[-1]
