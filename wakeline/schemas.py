"""Schemas of trace files as DDL.  All fields are nullable; unsigned 64-bit arguments are DECIMAL(20,0)."""

RAW_EVENTS = (
    "type string, ts_ns bigint, pid int, tid int, comm string, child_pid int, syscall_id int, syscall string, ret bigint, latency_ns bigint, "
    "arg0 decimal(20,0), arg1 decimal(20,0), arg2 decimal(20,0), arg3 decimal(20,0), arg4 decimal(20,0), path string, file_offset bigint, offset_src int, "
    "function_id int, function string, stdio_fd int, library string, count bigint, datatype_handle decimal(20,0), bytes bigint, bytes_resolved boolean, "
    "wall_start_ns bigint, mono_start_ns bigint, root_pid int, _corrupt_record string"
)
AGENT_EVENTS = (
    "type string, run_id string, parent_run_id string, parent_subagent_run_id string, toolCallId string, tool_name string, agent_role string, genomas_role string, "
    "phase string, provider string, vendor string, model string, cache_key string, cache_hit boolean, attempt int, delta_type string, delta_chars int, delta_tokens_est int, "
    "timestamp double, wall_time_ms double, monotonic_ns bigint, error string, error_type string, error_status_code int, stdout_len int, code_len int, io_layers array<string>, "
    "message struct<role:string,timestamp:double,usage:struct<input:bigint,output:bigint,cacheRead:bigint,totalTokens:bigint,cacheReadAvailable:boolean,cacheReadSource:string>>, "
    "assistantMessageEvent struct<type:string,delta:string,toolCall:struct<id:string,name:string>>, result struct<content:array<struct<text:string>>>, _corrupt_record string"
)
MESSAGES = (
    "run_id string, timestamp double, agent_role string, genomas_role string, phase string, provider string, vendor string, model string, cache_key string, "
    "messages array<struct<role:string,content:string,tool_call_id:string,name:string>>, response_text string, nocache_tag string, _corrupt_record string"
)
GENERATED_CODE = "run_id string, role string, timestamp double, phase string, code_len int, code_sha256 string, imports array<string>, io_layers array<string>, parsed boolean, code string, _corrupt_record string"
LLM_CACHE = "cache_key string, result string, _corrupt_record string"
EXECUTION_UNITS = "execution_unit_id string, task_id string, stage string, pid int, start_ts_ms double, end_ts_ms double, status string, returncode int, dependencies array<string>, inputs array<string>, outputs array<string>, _corrupt_record string"
ARTIFACTS = (
    "path string, category string, size_bytes bigint, n_reads int, n_writes int, total_read_bytes bigint, total_write_bytes bigint, fanout_codeexec int, fanout_roles int, "
    "reader_roles string, writer_roles string, lineage_depth_generations int, n_touching_calls int, lifecycle_class string, t_create double, t_last_read double, dead_seconds double, "
    "waste_byte_seconds bigint, reuse_class string, true_size bigint, size_source string, read_amplification double"
)
FS_ENTRIES = (
    "pid int, tid int, timestamp string, ts_ms double, syscall string, args string, return_value bigint, duration double, path string, bytes_transferred bigint, matched_tool_call string, "
    "resource_bucket string, errno string, errno_desc string, file_descriptor int, open_flags string, requested_size bigint, actual_size bigint, offset bigint, offset_src int, "
    "open_generation int, append boolean, flags bigint, dirfd decimal(20,0)"
)
REPLAY_REQUESTS = "arm string, rep string, call int, s double, e double, first_token double, input bigint, output bigint, _corrupt_record string"
MANIFEST = "run_id string, workflow string, model string, provider string, started_at string, path_prefixes array<string>, dataset_roots array<string>"
SERVER_TOKENS = "run_id string, tokens array<int>, token_strs array<string>"
