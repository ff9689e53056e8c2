"""Sources, paths, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import readable as R
from ..operators import detect as D
from ..sources import eventlog as E
from ..sources import sinks
from . import surrogate as X
from .registry import query, rounded


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a log: a start for each user's log, then jobs, ends and others."""
    e = X.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "SparkListenerApplicationStart").when(F.col("event_type") == "click", "SparkListenerJobStart").when(F.col("event_type") == "view", "SparkListenerJobEnd").when((F.col("event_type") == "purchase") & (F.col("user_id") % 10 < 7), "SparkListenerSQLExecutionStart").otherwise("SparkListenerOther")
    ms = X.ms("ts")
    value = F.to_json(F.struct(kind.alias("Event"), F.col("event_id").alias("Job ID"), ms.alias("Submission Time"), (ms + 5).alias("Completion Time"), F.array("event_id").alias("Stage IDs"), ms.alias("Timestamp")))
    return e.select((F.col("user_id") % 10).cast("string").alias("log_name"), F.col("event_id").alias("place"), value.alias("value")).withColumn("event", E.event_of(F.col("value")))


_LINE = """line AS (SELECT CAST(user_id % 10 AS VARCHAR) AS log_name, event_id AS place, epoch_us(ts) // 1000 AS ms,
  CASE event_type WHEN 'signup' THEN 'SparkListenerApplicationStart' WHEN 'click' THEN 'SparkListenerJobStart' WHEN 'view' THEN 'SparkListenerJobEnd' WHEN 'purchase' THEN CASE WHEN user_id % 10 < 7 THEN 'SparkListenerSQLExecutionStart' ELSE 'SparkListenerOther' END ELSE 'SparkListenerOther' END AS event FROM events),
begin AS (SELECT log_name, min(place) AS begin FROM line WHERE event = 'SparkListenerApplicationStart' GROUP BY 1),
after AS (SELECT line.* FROM line JOIN begin USING (log_name) WHERE place > begin)"""


@query(f"""WITH {_LINE} SELECT log_name, place AS job_id, CASE event WHEN 'SparkListenerJobStart' THEN 'start' ELSE 'end' END AS event_type, CASE event WHEN 'SparkListenerJobStart' THEN ms ELSE ms + 5 END AS job_timestamp,
CASE event WHEN 'SparkListenerJobStart' THEN CAST(place AS VARCHAR) END AS stages FROM after WHERE event IN ('SparkListenerJobStart', 'SparkListenerJobEnd')""")
def log_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.jobs(E.after_start(_lines(spark, sf_dir))).withColumn("stages", F.array_join(F.col("stages").cast("array<string>"), ","))


@query(f"WITH {_LINE} SELECT log_name, max(event = 'SparkListenerSQLExecutionStart') AS has_queries FROM line GROUP BY 1")
def log_has_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.has_queries(_lines(spark, sf_dir))


def _say(value: str, unit: str) -> str:
    return f"CAST(CAST(round(CAST({value} AS DECIMAL(38,6)), 2) AS DECIMAL(37,2)) AS VARCHAR) || ' {unit}'"


@query(f"""WITH d AS (SELECT user_id, min(epoch_us(ts) // 1000) AS first, max(epoch_us(ts) // 1000) AS last FROM events GROUP BY 1), s AS (SELECT user_id, (last - first) / 1000.0 AS s FROM d)
SELECT user_id, CASE WHEN s < 60 THEN {_say('s', 'sec')} WHEN s < 3600 THEN {_say('s / 60.0', 'min')} WHEN s < 86400 THEN {_say('s / 3600.0', 'hr')} ELSE {_say('s / 86400.0', 'days')} END AS duration FROM s""")
def log_catalog_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(X.ms("ts")).alias("first"), F.max(X.ms("ts")).alias("last"))
    return e.select("user_id", E.log_duration(F.col("first"), F.col("last")).alias("duration"))


@query("""SELECT doc_id, CASE WHEN lang IN ('fr', 'de') THEN NULL WHEN lang = 'en' THEN 'count' ELSE 'show' END AS query_function FROM documents""")
def query_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = X.table(spark, sf_dir, "documents")
    said = F.concat(F.when(F.col("lang") == "en", "count").when(F.col("lang") == "es", "show").otherwise("mapPartitions"), F.lit(" at "), F.col("source"))
    return d.select("doc_id", E.query_function(said).alias("query_function"))


@query(r"""SELECT page_id, regexp_extract(rtrim(url, '/'), '[^/]+$') AS name, regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]+$'), '(.)\.[^.]*$', '\1') AS stem, false AS cloud FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = X.table(spark, sf_dir, "pages")
    return p.select("page_id", R.path_name(F.col("url")).alias("name"), R.path_stem(F.col("url")).alias("stem"), R.is_cloud_path(F.col("url")).alias("cloud"))


@query("""SELECT doc_id, source, CASE WHEN n_chars >= 1000000 THEN CAST(CAST(round(CAST(n_chars / 1000000.0 AS DECIMAL(38,6)), 1) AS DECIMAL(37,1)) AS VARCHAR) || 'M'
WHEN n_chars >= 1000 THEN CAST(CAST(round(CAST(n_chars / 1000.0 AS DECIMAL(38,6)), 1) AS DECIMAL(37,1)) AS VARCHAR) || 'K' ELSE CAST(n_chars AS VARCHAR) END AS rows FROM documents""")
def count_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table(spark, sf_dir, "documents").select("doc_id", "source", R.count_text(F.col("n_chars")).alias("rows"))


@query(f"""WITH {X.METRIC}, a AS (SELECT query_id, node_id, list(upd ORDER BY line_no) AS u, list(DISTINCT metric_name) AS m FROM metric GROUP BY 1, 2),
b AS (SELECT query_id, node_id, unnest(u) AS accumulators_value, m FROM a) SELECT query_id, node_id, accumulators_value, unnest(m) AS accumulator_totals_metric_name FROM b""")
def csv_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.metrics(spark, sf_dir).groupBy("query_id", "node_id").agg(F.collect_list(F.struct(F.col("upd").alias("value"))).alias("accumulators"), F.collect_set(F.struct("metric_name")).alias("accumulator_totals"))
    return sinks.flatten_dag(rows)


@query(f"""WITH {X.TASK} SELECT query_id, stage_id, CAST(sum(memory_bytes_spilled) FILTER (WHERE memory_bytes_spilled > 0 OR disk_bytes_spilled > 0) AS BIGINT) AS memory_bytes_spilled,
CAST(sum(disk_bytes_spilled) FILTER (WHERE memory_bytes_spilled > 0 OR disk_bytes_spilled > 0) AS BIGINT) AS disk_bytes_spilled, count(*) FILTER (WHERE memory_bytes_spilled > 0 OR disk_bytes_spilled > 0) AS spilled_tasks,
{rounded('median(task_duration_seconds)', 3)} AS median, {rounded('max(task_duration_seconds)', 3)} AS longest, CAST(sum(shuffle_bytes_written) + sum(shuffle_bytes_read) AS BIGINT) AS shuffled FROM task GROUP BY 1, 2""")
def stage_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stage_statistics(X.tasks(spark, sf_dir)).withColumns({c: R.exact_round(F.col(c), 3) for c in ("median", "longest")})


@query("""SELECT date_trunc('day', ts) AS start, CAST(user_id % 10 AS VARCHAR) AS log_name, event_type AS event, count(*) AS n FROM events GROUP BY ALL""")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of events as a stream gives them, run to the end of what is there."""
    import uuid

    from ..streaming.tail import event_counts

    schema = X.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(sf_dir)
    events = rows.select((F.col("user_id") % 10).cast("string").alias("log_name"), F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("value"))
    name = f"windows_{uuid.uuid4().hex}"
    run = event_counts(events, "1 day").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("window.start").alias("start"), "log_name", "event", "n")
