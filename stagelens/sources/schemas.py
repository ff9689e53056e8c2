"""Schemas of event-log lines, of the canonical tables and of the two published relations."""

from __future__ import annotations

# Keys of the event log and our names for them.
TASK = [
    ("Executor Deserialize Time", "executor_deserialize_time"),
    ("Executor Deserialize CPU Time", "executor_deserialize_cpu_time"),
    ("Executor Run Time", "executor_run_time"),
    ("Executor CPU Time", "executor_cpu_time"),
    ("Peak Execution Memory", "peak_execution_memory"),
    ("Result Size", "result_size"),
    ("JVM GC Time", "jvm_gc_time"),
    ("Result Serialization Time", "result_serialization_time"),
    ("Memory Bytes Spilled", "memory_bytes_spilled"),
    ("Disk Bytes Spilled", "disk_bytes_spilled"),
]
SHUFFLE_READ = [
    ("Remote Blocks Fetched", "shuffle_remote_blocks_fetched"),
    ("Local Blocks Fetched", "shuffle_local_blocks_fetched"),
    ("Fetch Wait Time", "shuffle_fetch_wait_time"),
    ("Remote Bytes Read", "shuffle_remote_bytes_read"),
    ("Remote Bytes Read To Disk", "shuffle_remote_bytes_read_to_disk"),
    ("Local Bytes Read", "shuffle_local_bytes_read"),
    ("Total Records Read", "shuffle_records_read"),
    ("Remote Requests Duration", "shuffle_remote_requests_duration"),
]
PUSH = [
    ("Corrupt Merged Block Chunks", "merged_corrupt_block_chunks"),
    ("Merged Fetch Fallback Count", "merged_fetch_fallback_count"),
    ("Merged Remote Blocks Fetched", "merged_remote_blocks_fetched"),
    ("Merged Local Blocks Fetched", "merged_local_blocks_fetched"),
    ("Merged Remote Chunks Fetched", "merged_remote_chunks_fetched"),
    ("Merged Local Chunks Fetched", "merged_local_chunks_fetched"),
    ("Merged Remote Bytes Read", "merged_remote_bytes_read"),
    ("Merged Local Bytes Read", "merged_local_bytes_read"),
    ("Merged Remote Requests Duration", "merged_remote_requests_duration"),
]
SHUFFLE_WRITE = [
    ("Shuffle Bytes Written", "shuffle_bytes_written"),
    ("Shuffle Write Time", "shuffle_write_time"),
    ("Shuffle Records Written", "shuffle_records_written"),
]
INPUT = [
    ("Bytes Read", "bytes_read"),
    ("Records Read", "records_read"),
]
OUTPUT = [
    ("Bytes Written", "bytes_written"),
    ("Records Written", "records_written"),
]
EXECUTOR = [
    ("JVMHeapMemory", "jvm_heap_memory"),
    ("JVMOffHeapMemory", "jvm_offheap_memory"),
    ("OnHeapExecutionMemory", "onheap_execution_memory"),
    ("OffHeapExecutionMemory", "offheap_execution_memory"),
    ("OnHeapStorageMemory", "onheap_storage_memory"),
    ("OffHeapStorageMemory", "offheap_storage_memory"),
    ("OnHeapUnifiedMemory", "onheap_unified_memory"),
    ("OffHeapUnifiedMemory", "offheap_unified_memory"),
    ("DirectPoolMemory", "direct_pool_memory"),
    ("MappedPoolMemory", "mapped_pool_memory"),
    ("ProcessTreeJVMVMemory", "process_tree_jvm_vmemory"),
    ("ProcessTreeJVMRSSMemory", "process_tree_jvm_rss_memory"),
    ("ProcessTreePythonVMemory", "process_tree_python_vmemory"),
    ("ProcessTreePythonRSSMemory", "process_tree_python_rss_memory"),
    ("ProcessTreeOtherVMemory", "process_tree_other_vmemory"),
    ("ProcessTreeOtherRSSMemory", "process_tree_other_rss_memory"),
    ("MinorGCCount", "minor_gc_count"),
    ("MinorGCTime", "minor_gc_time"),
    ("MajorGCCount", "major_gc_count"),
    ("MajorGCTime", "major_gc_time"),
    ("TotalGCTime", "total_gc_time"),
]
# First words of descriptions that name a query's function.
QUERY_FUNCTIONS = ["count", "save", "createOrReplaceTempView", "show", "collect", "first", "head", "take", "foreach", "foreachPartition", "toLocalIterator"]

# Columns of the task relation, in order.
COMBINED_COLUMNS = [
    "log_name",
    "parsed_log_name",
    "query_id",
    "query_function",
    "query_start_timestamp",
    "query_end_timestamp",
    "query_duration_seconds",
    "job_id",
    "stage_id",
    "job_start_timestamp",
    "job_end_timestamp",
    "job_duration_seconds",
    "stage_start_timestamp",
    "stage_end_timestamp",
    "stage_duration_seconds",
    "task_id",
    "task_start_timestamp",
    "task_end_timestamp",
    "task_duration_seconds",
    "nodes",
    "executor_run_time_seconds",
    "executor_cpu_time_seconds",
    "executor_deserialize_time_seconds",
    "executor_deserialize_cpu_time_seconds",
    "result_size_bytes",
    "jvm_gc_time_seconds",
    "result_serialization_time_seconds",
    "memory_bytes_spilled",
    "disk_bytes_spilled",
    "peak_execution_memory_bytes",
    "bytes_read",
    "records_read",
    "bytes_written",
    "records_written",
    "shuffle_remote_blocks_fetched",
    "shuffle_local_blocks_fetched",
    "shuffle_fetch_wait_time_seconds",
    "shuffle_remote_bytes_read",
    "shuffle_remote_bytes_read_to_disk",
    "shuffle_local_bytes_read",
    "shuffle_records_read",
    "shuffle_remote_requests_duration",
    "shuffle_bytes_read",
    "shuffle_bytes_written",
    "shuffle_write_time_seconds",
    "shuffle_records_written",
    "merged_corrupt_block_chunks",
    "merged_fetch_fallback_count",
    "merged_remote_blocks_fetched",
    "merged_local_blocks_fetched",
    "merged_remote_chunks_fetched",
    "merged_local_chunks_fetched",
    "merged_remote_bytes_read",
    "merged_local_bytes_read",
    "merged_remote_requests_duration",
    "executor_id",
    "host",
    "index",
    "attempt",
    "failed",
    "killed",
    "speculative",
    "task_loc",
    "task_type",
]
# Columns of the node relation, in order.
DAG_COLUMNS = [
    "query_id",
    "query_start_timestamp",
    "query_end_timestamp",
    "query_duration_seconds",
    "whole_stage_codegen_id",
    "node_id",
    "node_type",
    "child_nodes",
    "details",
    "query_function",
    "query_header",
    "accumulators",
    "accumulator_totals",
    "n_accumulators",
    "n_accumulator_totals",
    "node_duration_minutes",
    "node_id_adj",
    "node_name",
]


def _longs(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{key}`: bigint" for key, _ in pairs)


JOB = "`Job ID` bigint, `Submission Time` bigint, `Completion Time` bigint, `Stage IDs` array<bigint>"
STAGE = "`Stage Info` struct<`Stage ID`: bigint, `Stage Attempt ID`: bigint, `Submission Time`: bigint, `Completion Time`: bigint>"
ACCUMULABLE = "struct<`ID`: bigint, `Name`: string, `Update`: string, `Value`: string, `Internal`: boolean, `Count Failed Values`: boolean, `Metadata`: string>"
TASK_END = (
    "`Stage ID` bigint, `Stage Attempt ID` bigint, `Task Type` string, "
    "`Task Info` struct<`Task ID`: bigint, `Index`: bigint, `Attempt`: bigint, `Launch Time`: bigint, `Finish Time`: bigint, `Executor ID`: string, `Host`: string, `Locality`: string, "
    f"`Speculative`: boolean, `Failed`: boolean, `Killed`: boolean, `Accumulables`: array<{ACCUMULABLE}>>, "
    f"`Task Executor Metrics` struct<{_longs(EXECUTOR)}>, "
    f"`Task Metrics` struct<{_longs(TASK)}, `Shuffle Read Metrics`: struct<{_longs(SHUFFLE_READ)}, `Push Based Shuffle`: struct<{_longs(PUSH)}>>, "
    f"`Shuffle Write Metrics`: struct<{_longs(SHUFFLE_WRITE)}>, `Input Metrics`: struct<{_longs(INPUT)}>, `Output Metrics`: struct<{_longs(OUTPUT)}>>"
)
QUERY = "executionId bigint, description string, time bigint, physicalPlanDescription string"
DRIVER = "executionId bigint, accumUpdates array<array<bigint>>"

METRIC = "struct<stage_id: bigint, task_id: bigint, accumulator_id: bigint, metric_name: string, metric_type: string, value: double, unit: string, readable_value: double, readable_unit: string, readable_str: string>"
RUN_RECORD = (
    "run_id string, run_at timestamp, log_name string, duration_s double, bytes_read bigint, bytes_written bigint, shuffle_bytes bigint, spill_bytes bigint, "
    "n_queries bigint, n_stages bigint, n_tasks bigint, n_cartesian_joins bigint, max_node_duration_min double, max_scan_bytes bigint"
)
