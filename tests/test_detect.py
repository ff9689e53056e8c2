import pytest
from pyspark.sql import functions as F
from stagelens.operators import detect as D
from stagelens.operators import graph as G
from stagelens.operators import telemetry as T


def dag(spark):
    """A merge join of two scans that gave 100 rows of 10 and 20, a cross hash join, and a nested loop."""
    total = lambda n: f"array(named_struct('metric_name', 'number of output rows', 'value', double({n})))"
    return spark.sql(
        f"""SELECT * FROM VALUES
        (1, 1, '[1] SortMergeJoin', 'SortMergeJoin', '2, 3', '{{"detail": {{"join_type": "Inner", "left_keys": ["a"], "right_keys": ["b"]}}}}', 2.0D, {total(100)}),
        (1, 2, '[2] Project', 'Project', '4', NULL, 0.5D, {total(5)}),
        (1, 3, '[3] Scan', 'Scan', '', '{{"detail": {{"location": {{"location": ["/r"]}}}}}}', 0.0D, {total(20)}),
        (1, 4, '[4] Scan', 'Scan', '', '{{"detail": {{"location": {{"location": ["/l"]}}}}}}', 0.0D, {total(10)}),
        (2, 1, '[1] BroadcastHashJoin', 'BroadcastHashJoin', '2', '{{"detail": {{"join_type": "Cross"}}}}', 1.0D, {total(0)}),
        (2, 2, '[2] BroadcastNestedLoopJoin', 'BroadcastNestedLoopJoin', '3', 'not json', 0.0D, NULL),
        (2, 3, '[3] Scan', 'Scan', '', '{{"detail": {{"location": {{"location": ["/l"]}}}}}}', 0.0D, {total(1)})
        AS t(query_id, node_id, node_name, node_type, child_nodes, details, node_duration_minutes, accumulator_totals)"""
    )


def test_row_explosion_names_both_sides(spark):
    (r,) = D.find_row_explosions(dag(spark)).collect()
    assert (r.query_id, r.node_id, r.output_rows, r.left_input_rows, r.right_input_rows, r.ratio) == (1, 1, 100, 10, 20, 5.0)
    assert r.left_scan_paths == ["/l"] and r.right_scan_paths == ["/r"] and r.left_keys == ["a"]


@pytest.mark.parametrize(("ratio", "n"), [(0, 1), (5.0, 1), (5.01, 0), (1e9, 0)])
def test_explosion_threshold(spark, ratio, n):
    assert D.find_row_explosions(dag(spark), ratio).count() == n


def test_cartesian_joins_by_query_and_node(spark):
    assert [(r.query_id, r.node_id) for r in D.cartesian_joins(dag(spark)).collect()] == [(2, 1), (2, 2)]


def test_repeated_scans_and_long_nodes(spark):
    (r,) = D.find_repeated_scans(dag(spark)).collect()
    assert (r.path, r.scan_count, r.query_ids) == ("/l", 2, [1, 2])
    assert [(r.query_id, r.node_id) for r in D.long_nodes(dag(spark)).collect()] == [(1, 1), (2, 1)]
    assert D.long_nodes(dag(spark), 1e9).count() == 0


def test_contraction_passes_hidden_nodes(spark):
    nodes = spark.createDataFrame([(1, 1, "Join"), (1, 2, "ShuffleQueryStage"), (1, 3, "ReusedExchange"), (1, 4, "Scan"), (1, 5, "Scan")], "query_id long, node_id long, node_type string")
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 1, 5)], "query_id long, parent_id long, child_id long")
    assert sorted((r.parent_id, r.child_id) for r in G.contract(nodes, edges).collect()) == [(1, 4), (1, 5)]


@pytest.mark.parametrize(("jobs", "idle"), [([(1, 0, 60_000), (2, 60_000, 90_000)], 0), ([(1, 0, 60_000), (2, 180_000, 200_000)], 120_000), ([(1, 0, 10_000), (2, 40_000, 50_000), (3, 170_000, 171_000)], 150_000), ([(1, 0, 100), (2, 50, 70)], 0)])
def test_idle_time(spark, jobs, idle):
    df = spark.createDataFrame(jobs, "job_id long, start_ms long, end_ms long")
    assert T.job_idle_time(df).first().idle_time_ms == idle


def test_several_driver_updates_multiply_rows_and_the_total_is_the_largest(spark):
    plan = spark.createDataFrame([("x", 1, 1, "m", 7, "sum")], "log_name string, query_id long, node_id long, metric_name string, accumulator_id long, metric_type string")
    tasks = spark.createDataFrame([], "log_name string, stage_id long, task_id long, accumulator_id long, update long, value long")
    updates = spark.createDataFrame([("x", 1, 7, 5, 1), ("x", 1, 7, 6, 2)], "log_name string, query_id long, accumulator_id long, update long, place long")
    driver = T.driver_running_total(updates, ("place",)).drop("place")
    long = T.accumulator_long(plan, tasks, driver)
    assert long.count() == 2 and T.metric_totals(long).first().value == 11.0


def test_rows_are_not_shuffled_after_they_multiply(spark):
    plan = spark.createDataFrame([("x", 1, n, "m", a, "sum") for n, a in ((1, 7), (2, 7), (3, 8), (4, 9), (5, None))], "log_name string, query_id long, node_id long, metric_name string, accumulator_id long, metric_type string")
    tasks = spark.createDataFrame([("x", 0, 1, 7, 5, 5), ("x", 0, 2, 7, None, None), ("y", 0, 3, 9, 1, 1)], "log_name string, stage_id long, task_id long, accumulator_id long, update long, value long")
    driver = spark.createDataFrame([("x", 1, 7, 3, 4), ("x", 1, 8, 6, 6)], "log_name string, query_id long, accumulator_id long, driver_update long, driver_value long")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        long = T.accumulator_long(plan, tasks, driver)
        steps = long._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    join = next(k for k, x in enumerate(steps) if "SortMergeJoin" in x and "Inner" in x)
    assert not any("Exchange" in x for x in steps[:join])
    got = {(r.node_id, r.task_id, r.value, r.update) for r in long.collect()}
    assert long.count() == 7 and got == {(1, 1, 5, 5), (1, 2, 4, 3), (2, 1, 5, 5), (2, 2, 4, 3), (3, None, 6, 6), (4, None, None, None), (5, None, None, None)}


def test_median_of_averages_replaces_the_total_in_text_too(spark):
    totals = spark.createDataFrame([("x", 1, 1, 0, 0, 7, "avg size", "average", 9.0, "", 9.0, "", "9.0")], "log_name string, query_id long, node_id long, stage_id long, task_id long, accumulator_id long, metric_name string, metric_type string, value double, unit string, readable_value double, readable_unit string, readable_str string")
    medians = spark.createDataFrame([("x", 7, 4.25)], "log_name string, accumulator_id long, median_of_average_value double")
    r = T.with_medians(totals, medians).first()
    assert (r.value, r.readable_value, r.readable_str) == (4.25, 4.3, "4.25")


def test_empty_relations_have_no_findings(spark):
    tasks = spark.createDataFrame([], "query_id long, stage_id long, task_duration_seconds double, memory_bytes_spilled long, disk_bytes_spilled long, shuffle_bytes_read long, shuffle_bytes_written long")
    assert D.issues(dag(spark).where(F.lit(False)), tasks).count() == 0


def test_reach_is_not_cut_in_deep_plans(spark):
    edges = spark.sql("SELECT 1 AS query_id, id AS parent_id, id + 1 AS child_id FROM range(5000)")
    starts = spark.sql("SELECT 1 AS query_id, 0L AS node_id")
    assert G.reach(starts, edges).count() == 5001


def test_reach_ends_in_cycles_and_keeps_logs_apart(spark):
    edges = spark.createDataFrame([("a", 1, 1, 2), ("a", 1, 2, 1), ("b", 1, 1, 3)], "log_name string, query_id long, parent_id long, child_id long")
    starts = spark.createDataFrame([("a", 1, "s", 1), ("b", 1, "s", 1), ("b", 1, "s", 1), ("c", 1, "t", 9)], "log_name string, query_id long, start string, node_id long")
    got = sorted(map(tuple, G.reach(starts, edges).collect()))
    assert got == [("a", 1, "s", 1), ("a", 1, "s", 2), ("b", 1, "s", 1), ("b", 1, "s", 3), ("c", 1, "t", 9)]


def test_scans_below_a_deep_chain(spark):
    nodes = [(1, 0, "SortMergeJoin")] + [(1, k, "Project") for k in range(1, 131)] + [(1, 131, "Scan"), (1, 200, "Scan")]
    edges = [(1, 0, 0, 1), (1, 0, 1, 200)] + [(1, k, 0, k + 1) for k in range(1, 131)]
    n = spark.createDataFrame(nodes, "query_id long, node_id long, node_type string")
    e = spark.createDataFrame(edges, "query_id long, parent_id long, child_ord int, child_id long")
    assert sorted(r.node_id for r in D.source_scans(n, spark.sql("SELECT 1L AS query_id, 0L AS node_id"), e).collect()) == [131, 200]


def test_stages_of_two_logs_stay_apart(spark):
    """Two applications number their queries and stages alike."""
    columns = "log_name string, query_id long, stage_id long, task_duration_seconds double, memory_bytes_spilled long, disk_bytes_spilled long, shuffle_bytes_read long, shuffle_bytes_written long"
    tasks = spark.createDataFrame([(log, 0, 0, s, 10 * k, 0, 1, 1) for k, log in ((1, "a"), (2, "b")) for s in (1.0, 1.0, 1.0)], columns)
    assert [(r.log_name, r.memory_bytes_spilled) for r in D.spill(tasks).collect()] == [("a", 30), ("b", 60)]
    assert D.skewed_tasks(tasks, 1.0).count() == D.heavy_shuffles(tasks).count() == 2
    reads = spark.createDataFrame([("a", 0, "[1] Scan", 5, 1), ("b", 0, "[1] Scan", 7, 1)], "log_name string, query_id long, node_name string, bytes_read long, records_read long")
    scans = spark.createDataFrame([("a", 0, "[1] Scan", "x"), ("b", 0, "[1] Scan", "y")], "log_name string, query_id long, node_name string, paths string")
    assert [(r.log_name, r.bytes_read, r.paths) for r in D.largest_scans(reads, scans).collect()] == [("b", 7, "y"), ("a", 5, "x")]
