"""The registered queries in SQL, straight from the ``events`` table.

The statements restate the derivation rules and compute each answer in another
form than the operators do: correlated "latest before" lookups instead of chunked
folds, suffix sums instead of prefix minima, and no JSON at all.
"""

from __future__ import annotations

from typing import NamedTuple

from emberlog.sources.schema import IO_COLUMNS, METRIC_COLUMNS, SHUFFLE_COLUMNS

# Fixed values, stated here again on purpose: a wrong entry in the reports must show
# as a difference. Series and their SQL, charts and their lines, JSON fields.
SERIES = {
    "appTimeline": "removed_time",
    "storageTimeline": "storage_remove_time",
    "inputBytes": "input_bytes // 1024",
    "outputBytes": "output_bytes // 1024",
    "shuffleReads": "remote_bytes_read // 1024",
    "shuffleWrites": "shuffle_bytes_written // 1024",
    "cpuTime": "executor_cpu_time // 1000000",
    "executorTime": "executor_run_time",
    "storageMem": "mem_used // 1024",
    "storageDisk": "disk_used // 1024",
    "resultSerTime": "result_serialization_time",
    "taskDeserTime": "executor_deserialize_time",
    "memorySpill": "memory_bytes_spilled // 1024",
    "diskSpill": "disk_bytes_spilled // 1024",
    "resultSize": "result_size // 1024",
    "shuffleWait": "shuffle_wait",
    "gcTime": "jvm_gc_time",
}
STORAGE_SERIES = ("storageMem", "storageDisk")
TASK_SERIES = (
    "inputBytes", "outputBytes", "shuffleReads", "shuffleWrites", "cpuTime", "executorTime",
    "resultSerTime", "taskDeserTime", "shuffleWait", "gcTime", "resultSize",
)


class Chart(NamedTuple):
    title: str
    lines: dict[str, str]
    own_axes: bool = False
    x: str = "appTimeline"


STORAGE = Chart(
    "storageChart", {"storageMem(kb)": "storageMem", "storageDisk(kb)": "storageDisk"}, x="storageTimeline"
)
SPILL = Chart("spillChart", {"memorySpill(kb)": "memorySpill", "diskSpill(kb)": "diskSpill"})
TASK_CHARTS = [
    Chart("ioChart", {"InputBytes(kb)": "inputBytes", "OutputBytes(kb)": "outputBytes"}, True),
    Chart("shuffleChart", {"shuffleReads(kb)": "shuffleReads", "shuffleWrites(kb)": "shuffleWrites"}, True),
    Chart("cpuChart", {"cpuTime(ms)": "cpuTime", "executionTime(ms)": "executorTime"}),
    Chart(
        "serializationChart",
        {"resultSerialization(ms)": "resultSerTime", "taskDeserization(ms)": "taskDeserTime"},
    ),
    Chart("otherChart", {"shuffleWait(ms)": "shuffleWait", "gc(ms)": "gcTime"}),
    Chart("driverBurden", {"resultSize(kb)": "resultSize"}),
]
APPLICATION_CHARTS = [*TASK_CHARTS, STORAGE, SPILL]
IO_JSON = {
    "diskBytesSpilled": "disk_bytes_spilled",
    "memoryBytesSpilled": "memory_bytes_spilled",
    "resultSerializationTime": "result_serialization_time",
    "executorDeserializeTime": "executor_deserialize_time",
    "inputBytes": "input_bytes",
    "inputRecords": "input_records",
    "outputBytes": "output_bytes",
    "outputRecords": "output_records",
}
SHUFFLE_JSON = {
    "shuffleWait": "shuffle_wait",
    "remoteBlockFetched": "remote_blocks_fetched",
    "localBlockFetched": "local_blocks_fetched",
    "totalBlockFetched": "total_blocks_fetched",
    "remoteBytesRead": "remote_bytes_read",
    "localBytesRead": "local_bytes_read",
    "totalBytesRead": "total_bytes_read",
    "recordRead": "records_read",
    "shuffleBytesWrite": "shuffle_bytes_written",
    "shuffleRecordWrite": "shuffle_record_write",
    "writeTime": "write_time",
}
EXECUTOR_JSON = {
    "executorId": "executor_id",
    "stageId": "stage_id",
    "totalCores": "total_cores",
    "tasksActive": "tasks_active",
    "tasksFailed": "tasks_failed",
    "tasksComplete": "tasks_complete",
    "duration": "duration",
    "jvmGCTime": "jvm_gc_time",
    "resultSize": "result_size",
    "isAlive": "is_alive",
    "executorLogs": "executor_logs",
    "addedTime": "added_time",
    "removedTime": "removed_time",
    "executorCpuTime": "executor_cpu_time",
    "executorRuntime": "executor_run_time",
    "ioMetrics": IO_JSON,
    "shuffleMetrics": SHUFFLE_JSON,
    "storageMetrics": {
        "addTime": "storage_add_time",
        "removeTime": "storage_remove_time",
        "maxMem": "max_mem",
        "isAlive": "storage_is_alive",
        "memUsed": "mem_used",
        "diskUsed": "disk_used",
    },
}
TASK_JSON = {
    "taskId": "task_id",
    "isAlive": "is_alive",
    "startTime": "start_time",
    "endTime": "end_time",
    "duration": "duration",
    "executorCpuTime": "executor_cpu_time",
    "executorRuntime": "executor_run_time",
    "jvmGCTime": "jvm_gc_time",
    "resultSize": "result_size",
    "failed": "failed",
    "killed": "killed",
    "failedReason": "failed_reason",
    "traceStack": "trace_stack",
    "ioMetrics": IO_JSON,
    "shuffleMetrics": SHUFFLE_JSON,
}

# The derivation rules of the metrics.
METRIC_RULES = {
    "executor_cpu_time": "(dur - dur//10)*800000 + id%1000",
    "executor_run_time": "dur - dur//10",
    "jvm_gc_time": "dur//20",
    "result_size": "1000 + id%4096",
    "disk_bytes_spilled": "CASE WHEN id%5=0 THEN id*1024 ELSE 0 END",
    "memory_bytes_spilled": "CASE WHEN id%5=0 THEN id*2048 ELSE 0 END",
    "result_serialization_time": "id%7",
    "executor_deserialize_time": "id%13",
    "input_bytes": "(id*1537)%1000003",
    "input_records": "id%999",
    "output_bytes": "(id*53)%200003",
    "output_records": "id%77",
    "shuffle_wait": "id%23",
    "remote_blocks_fetched": "id%17",
    "local_blocks_fetched": "id%11",
    "total_blocks_fetched": "id%17 + id%11",
    "remote_bytes_read": "(id*7919)%500009",
    "local_bytes_read": "(id*104729)%300007",
    "total_bytes_read": "(id*7919)%500009 + (id*104729)%300007",
    "records_read": "id%501",
    "shuffle_bytes_written": "(id*31)%400009",
    "shuffle_record_write": "0",
    "write_time": "id*1000%999983",
    "shuffle_records_written": "id%301",
}

_METRICS = ",\n    ".join(
    f"CAST(CASE WHEN measured THEN {METRIC_RULES[m]} ELSE 0 END AS BIGINT) AS {m}"
    for m in METRIC_COLUMNS
)


def _sums(columns=METRIC_COLUMNS, table="") -> str:
    return ", ".join(f"CAST(sum({table}{m}) AS BIGINT) AS {m}" for m in columns)


CTES = {
    "k": """SELECT *, launch + dur AS finish FROM (
    SELECT event_id AS id, event_type, epoch_us(ts)//1000 AS launch, user_id%3 AS app,
      1 + (user_id//3)%4 AS x, 'app-' || (user_id%3) AS log_id,
      CAST(1 + (user_id//3)%4 AS VARCHAR) AS executor_id, 1 + (event_id*37)%5000 AS dur
    FROM events)""",
    "span": """SELECT log_id, app, min(launch) AS t0, max(launch) AS t1 FROM k GROUP BY log_id, app""",
    "ex": """SELECT DISTINCT log_id, app, x, executor_id, t0, t1 FROM k JOIN span USING (log_id, app)""",
    "starts": """SELECT log_id, executor_id, id, id*16 AS seq, launch AS t, id//200 AS stage_id
    FROM k WHERE id%50 <> 0""",
    "ends": """SELECT *, CASE
      WHEN reason IN ('Resubmitted', 'ExceptionFailure', 'ExecutorLostFailure', 'FetchFailed',
        'TaskCommitDenied') THEN 'failed'
      WHEN reason = 'TaskKilled' THEN 'killed' ELSE 'complete' END AS outcome
    FROM (
      SELECT log_id, executor_id, x, id, (id + id%6)*16 + 8 + id%6 AS seq, launch, finish, dur,
        event_type, id%29 <> 0 AS measured, false AS again,
        CASE WHEN event_type = 'error' THEN ['Resubmitted', 'ExceptionFailure',
            'ExecutorLostFailure', 'FetchFailed', 'TaskCommitDenied'][id%5 + 1]
          WHEN event_type = 'signup' AND id%10 = 0 THEN 'TaskKilled'
          WHEN id%97 = 0 THEN 'TaskResultLost' ELSE 'Success' END AS reason
      FROM k WHERE id%61 <> 0
      UNION ALL
      SELECT log_id, executor_id, x, id, (id + 20)*16 + 15, launch, finish, dur, event_type,
        false, true, 'Resubmitted'
      FROM k WHERE event_type = 'view' AND id%11 = 0)""",
    "texts": """SELECT *,
    CASE reason WHEN 'Resubmitted' THEN 'Resubmitted (resubmitted due to lost executor)'
      WHEN 'ExceptionFailure' THEN 'boom ' || id
      WHEN 'ExecutorLostFailure' THEN 'ExecutorLostFailure (executor ' || executor_id ||
        ' exited ' || CASE WHEN id%2 = 0 THEN 'caused by one of' ELSE 'unrelated to' END ||
        ' the running tasks)' || CASE WHEN id%3 = 0 THEN ' Reason: lost heartbeat' ELSE '' END
      WHEN 'FetchFailed' THEN 'FetchFailed(' ||
        CASE WHEN id%2 = 0 THEN 'BlockManagerId(' || x || ', host' || x || ', 7000, None)'
          ELSE 'null' END || ', shuffleId=' || id%9 ||
        CASE WHEN id%3 = 0 THEN '' ELSE ', mapIndex=' || id%30 END || ', mapId=' || id%31 ||
        ', reduceId=' || id%7 || ', message=' || chr(10) || 'fetch ' || id || chr(10) || ')'
      WHEN 'TaskCommitDenied' THEN 'TaskCommitDenied (Driver denied task commit) for job: ' ||
        id%12 || ', partition: ' || id%13 || ', attemptNumber: ' || id%3
      END AS failed_reason,
    CASE WHEN reason = 'ExceptionFailure' THEN 'java.lang.RuntimeException: boom ' || id ||
      chr(10) || chr(9) || 'at Job.run(Job.scala:' || id%100 || ')' END AS trace_stack
    FROM ends""",
    "measured": f"""SELECT log_id, executor_id, id, seq, outcome, dur,
    {_METRICS}
    FROM ends""",
    "life": """SELECT log_id, 'driver' AS executor_id, -3000 AS seq, 'bm+' AS kind,
      t0 - 3000 AS t, 500000 AS max_mem, 0 AS cores, NULL AS url FROM span
    UNION ALL SELECT log_id, executor_id, -2000 + x, 'ex+', t0 - 2000 + x, NULL, x*2,
      '{"stderr":"http://host' || x || '/stderr"}' FROM ex
    UNION ALL SELECT log_id, executor_id, -1000 + x, 'bm+', t0 - 1000 + x, x*1000000, NULL, NULL
      FROM ex WHERE x <= 3
    UNION ALL SELECT log_id, executor_id, id*16 + 6, 'bm+', launch, x*1000000, NULL, NULL
      FROM k WHERE id%2000 = 1999 AND x <> 4
    UNION ALL SELECT log_id, executor_id, 1000000003, 'ex-', t1 + 6000, NULL, NULL, NULL
      FROM ex WHERE x = 3
    UNION ALL SELECT log_id, executor_id, 1000000012, 'bm-', t1 + 6500, NULL, NULL, NULL
      FROM ex WHERE x = 2""",
    "app_start": """SELECT log_id, app, -2800 AS seq, t0 - 2500 AS t FROM span""",
    "app_end": """SELECT log_id, 1000000020 AS seq, t1 + 7000 AS t FROM span WHERE app <> 2""",
    "clock": """SELECT log_id, seq, t FROM starts UNION ALL SELECT log_id, seq, finish FROM ends
    UNION ALL SELECT log_id, seq, t FROM life UNION ALL SELECT log_id, seq, t FROM app_start
    UNION ALL SELECT log_id, seq, t FROM app_end""",
    "seen": """SELECT log_id, executor_id, min(seq) AS first_seen FROM (
      SELECT log_id, executor_id, seq FROM starts UNION ALL SELECT log_id, executor_id, seq FROM ends
      UNION ALL SELECT log_id, executor_id, seq FROM life WHERE kind IN ('ex+', 'bm+'))
    GROUP BY log_id, executor_id""",
    # The application end as one more event of every executor not removed by then.
    "closing": """SELECT s.log_id, s.executor_id, e.seq, 'end' AS kind, e.t FROM seen s
    JOIN app_end e USING (log_id) WHERE s.first_seen < e.seq AND NOT EXISTS (
      SELECT 1 FROM life l WHERE l.log_id = s.log_id AND l.executor_id = s.executor_id
        AND l.kind = 'ex-' AND l.seq > s.first_seen AND l.seq < e.seq)""",
    "moves": """SELECT l.log_id, l.executor_id, l.seq, l.kind, l.t FROM life l
      JOIN seen s USING (log_id, executor_id) WHERE l.kind IN ('ex+', 'bm+') OR l.seq > s.first_seen
    UNION ALL SELECT * FROM closing
    UNION ALL SELECT log_id, 'driver', seq, 'start', t FROM app_start WHERE app = 0""",
    "lifecycle": """SELECT s.log_id, s.executor_id,
      coalesce((SELECT arg_max(cores, seq) FROM life l WHERE l.log_id = s.log_id AND
        l.executor_id = s.executor_id AND l.kind = 'ex+'), 0)::INTEGER AS total_cores,
      coalesce(m.is_alive, true) AS is_alive,
      CASE WHEN s.executor_id <> 'driver' THEN (SELECT arg_max(url, seq) FROM life l
          WHERE l.log_id = s.log_id AND l.executor_id = s.executor_id AND l.kind = 'ex+')
        WHEN s.log_id = 'app-0' THEN '{"stdout":"http://host0/stdout"}' ELSE '{}' END
        AS executor_logs,
      coalesce(m.added, m.first_manager, 0)::BIGINT AS added_time,
      coalesce(m.removed, 0)::BIGINT AS removed_time,
      coalesce(m.storage_added, 0)::BIGINT AS storage_add_time,
      coalesce(m.storage_removed, 0)::BIGINT AS storage_remove_time,
      coalesce((SELECT arg_max(max_mem, seq) FROM life l WHERE l.log_id = s.log_id AND
        l.executor_id = s.executor_id AND l.kind = 'bm+'), 0)::BIGINT AS max_mem,
      coalesce(m.storage_alive, true) AS storage_is_alive, s.first_seen
    FROM seen s LEFT JOIN (
      SELECT log_id, executor_id,
        NOT bool_or(kind IN ('ex-', 'end')) AS is_alive,
        arg_max(t, seq) FILTER (kind IN ('ex+', 'start')) AS added,
        arg_min(t, seq) FILTER (kind = 'bm+') AS first_manager,
        arg_max(t, seq) FILTER (kind IN ('ex-', 'end')) AS removed,
        arg_max(t, seq) FILTER (kind IN ('ex+', 'bm+')) AS storage_added,
        arg_max(t, seq) FILTER (kind IN ('ex-', 'bm-', 'end')) AS storage_removed,
        arg_max(kind = 'bm+', seq) FILTER (kind IN ('bm+', 'bm-', 'end')) AS storage_alive
      FROM moves GROUP BY log_id, executor_id) m USING (log_id, executor_id)""",
    # Highest suffix sum of +1 / -1 steps, at least 0: a counter that stops at 0.
    "active": """SELECT log_id, executor_id, greatest(0, max(rest))::BIGINT AS tasks_active FROM (
      SELECT log_id, executor_id, sum(d) OVER (PARTITION BY log_id, executor_id ORDER BY seq
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
      FROM (SELECT log_id, executor_id, seq, 1 AS d FROM starts
        UNION ALL SELECT log_id, executor_id, seq, -1 FROM ends))
    GROUP BY log_id, executor_id""",
    "totals": f"""SELECT log_id, executor_id,
      coalesce((SELECT arg_max(stage_id, seq) FROM starts s WHERE s.log_id = m.log_id AND
        s.executor_id = m.executor_id), 0)::INTEGER AS stage_id,
      count(*) FILTER (outcome = 'failed') AS tasks_failed,
      count(*) FILTER (outcome = 'complete') AS tasks_complete,
      sum(dur)::BIGINT AS duration, {_sums()}
    FROM measured m GROUP BY log_id, executor_id""",
    "summed": f"""SELECT log_id, id, {_sums()} FROM measured GROUP BY log_id, id""",
    "flags": """SELECT log_id, id,
      bool_or(outcome = 'failed') AS failed, bool_or(outcome = 'killed') AS killed,
      arg_max(finish, seq) AS end_time, arg_max(dur, seq) AS duration,
      arg_max(failed_reason, seq) FILTER (outcome = 'failed') AS failed_reason,
      arg_max(trace_stack, seq) FILTER (reason = 'ExceptionFailure') AS trace_stack
    FROM texts GROUP BY log_id, id""",
    "task": f"""SELECT k.log_id, k.executor_id, k.id AS task_id, s.seq AS start_seq,
      f.id IS NULL AS is_alive, coalesce(s.t, 0)::BIGINT AS start_time,
      coalesce(f.end_time, 0)::BIGINT AS end_time, coalesce(f.duration, 0)::BIGINT AS duration,
      coalesce(f.failed, false) AS failed, coalesce(f.killed, false) AS killed,
      f.failed_reason, f.trace_stack, false AS no_finish_time,
      {", ".join(f"coalesce(m.{c}, 0)::BIGINT AS {c}" for c in METRIC_COLUMNS)}
    FROM k LEFT JOIN starts s ON s.log_id = k.log_id AND s.id = k.id
      LEFT JOIN flags f ON f.log_id = k.log_id AND f.id = k.id
      LEFT JOIN summed m ON m.log_id = k.log_id AND m.id = k.id
    WHERE s.id IS NOT NULL OR f.id IS NOT NULL""",
    "listed": """SELECT *, row_number() OVER (PARTITION BY log_id, executor_id ORDER BY start_seq) - 1
      AS position FROM task WHERE start_seq IS NOT NULL""",
    "updates": """SELECT u.*, (SELECT count(*) FROM life b WHERE b.log_id = u.log_id AND
        b.executor_id = u.executor_id AND b.kind = 'bm+' AND b.seq < u.seq) AS incarnation
    FROM (
      SELECT log_id, executor_id, seq, 0 AS pos, false AS is_last, finish AS t,
        'rdd_' || id%3 || '_' || id%8 AS block_id, id%3 AS rdd_id, id FROM ends
      WHERE event_type = 'purchase' AND measured
      UNION ALL SELECT log_id, executor_id, seq, 1, true, finish, 'broadcast_' || id%5, NULL, id
        FROM ends WHERE event_type = 'purchase' AND measured
      UNION ALL SELECT log_id, executor_id, id*16 + 4, 0, true, NULL,
        'rdd_' || id%3 || '_' || id%4, id%3, id FROM k WHERE event_type = 'click' AND id%4 = 0) u""",
    "stored": """SELECT log_id, executor_id, incarnation, seq, pos, is_last, t, block_id, rdd_id,
      id%7 <> 0 AS live, CASE WHEN id%7 = 0 THEN 0 ELSE (1 + id%50)*1024 END AS mem,
      CASE WHEN id%7 = 0 THEN 0 ELSE (id%4)*512 END AS disk
    FROM updates WHERE incarnation > 0""",
    "drops": """SELECT log_id, id*16 + 5 AS seq, id%3 AS rdd_id FROM k WHERE id%250 = 249""",
    "asked": """SELECT log_id, seq FROM drops
    UNION ALL SELECT log_id, id*16 + 4 FROM k WHERE event_type = 'click' AND id%4 = 0""",
    "as_of": """SELECT a.log_id, a.seq, coalesce(max(c.t), -1)::BIGINT AS timeline
    FROM asked a LEFT JOIN clock c ON c.log_id = a.log_id AND c.seq < a.seq
    GROUP BY a.log_id, a.seq""",
    # Latest status of every block of a manager at every unpersist event.
    "at_drop": """SELECT d.log_id, d.seq, d.rdd_id, s.executor_id, s.incarnation, s.block_id,
      arg_max(s.live, s.seq*4 + s.pos) AS live
    FROM drops d JOIN stored s ON s.log_id = d.log_id AND s.rdd_id = d.rdd_id AND s.seq < d.seq
    GROUP BY ALL""",
    "touched": """SELECT log_id, executor_id, incarnation, rdd_id, seq, count(*) AS copies
    FROM at_drop a WHERE live AND incarnation = (SELECT count(*) FROM life b
      WHERE b.log_id = a.log_id AND b.executor_id = a.executor_id AND b.kind = 'bm+'
        AND b.seq < a.seq)
    GROUP BY ALL""",
    "points": """SELECT log_id, executor_id, incarnation, seq, t, 1 AS copies FROM stored
      WHERE is_last
    UNION ALL SELECT log_id, executor_id, incarnation, seq, NULL, copies FROM touched""",
    "held": """SELECT log_id, executor_id, seq, t, copies, CAST(sum(mem) AS BIGINT) AS mem_used,
      CAST(sum(disk) AS BIGINT) AS disk_used
    FROM (
      SELECT p.log_id, p.executor_id, p.seq, p.t, p.copies, s.block_id,
        arg_max(s.mem, s.seq*4 + s.pos) AS mem, arg_max(s.disk, s.seq*4 + s.pos) AS disk
      FROM points p JOIN stored s ON s.log_id = p.log_id AND s.executor_id = p.executor_id
        AND s.incarnation = p.incarnation AND s.seq <= p.seq
      GROUP BY ALL)
    GROUP BY log_id, executor_id, seq, t, copies""",
    "samples": """SELECT log_id, executor_id, coalesce(t, timeline)::BIGINT AS time,
      mem_used, disk_used, row_number() OVER (PARTITION BY log_id, executor_id ORDER BY seq) - 1
        AS position
    FROM (SELECT *, unnest(generate_series(1, copies)) AS n FROM held)
      LEFT JOIN as_of USING (log_id, seq)""",
    "in_use": """SELECT log_id, executor_id, arg_max(mem_used, seq) AS mem_used,
      arg_max(disk_used, seq) AS disk_used FROM held GROUP BY log_id, executor_id""",
    # Unpersist events that end a block's life: the first after each stored status.
    "released": """SELECT s.log_id, s.executor_id, s.incarnation, d.seq, s.block_id
    FROM stored s JOIN drops d ON d.log_id = s.log_id AND d.rdd_id = s.rdd_id AND d.seq > s.seq
    WHERE s.live AND d.seq < coalesce((SELECT min(n.seq) FROM stored n
        WHERE n.log_id = s.log_id AND n.executor_id = s.executor_id
          AND n.incarnation = s.incarnation AND n.block_id = s.block_id AND n.seq > s.seq), 4000000000000000000)
      AND d.seq < coalesce((SELECT min(b.seq) FROM life b WHERE b.log_id = s.log_id AND
        b.executor_id = s.executor_id AND b.kind = 'bm+' AND b.seq > s.seq), 4000000000000000000)
    QUALIFY row_number() OVER (PARTITION BY s.log_id, s.executor_id, s.incarnation, s.block_id,
      s.seq ORDER BY d.seq) = 1""",
    "changes": """SELECT log_id, executor_id, incarnation, seq, pos::BIGINT AS pos, is_last, t,
      block_id, mem, disk FROM stored
    UNION ALL SELECT log_id, executor_id, incarnation, seq, row_number() OVER (PARTITION BY log_id,
      executor_id, incarnation, seq ORDER BY block_id) - 1, true, NULL, block_id, 0, 0
    FROM released""",
    "left_after": """SELECT log_id, executor_id, seq, pos, t, CAST(sum(mem) AS BIGINT) AS mem_used,
      CAST(sum(disk) AS BIGINT) AS disk_used
    FROM (
      SELECT p.log_id, p.executor_id, p.seq, p.pos, p.t, c.block_id,
        arg_max(c.mem, c.seq*4096 + c.pos) AS mem, arg_max(c.disk, c.seq*4096 + c.pos) AS disk
      FROM changes p JOIN changes c ON c.log_id = p.log_id AND c.executor_id = p.executor_id
        AND c.incarnation = p.incarnation AND (c.seq, c.pos) <= (p.seq, p.pos)
      WHERE p.is_last GROUP BY ALL)
    GROUP BY log_id, executor_id, seq, pos, t""",
    "summary": f"""SELECT l.log_id AS app_id, l.log_id, l.executor_id, l.first_seen,
      coalesce(t.stage_id, 0)::INTEGER AS stage_id, l.total_cores,
      coalesce(a.tasks_active, 0)::BIGINT AS tasks_active,
      coalesce(t.tasks_failed, 0)::BIGINT AS tasks_failed,
      coalesce(t.tasks_complete, 0)::BIGINT AS tasks_complete,
      coalesce(t.duration, 0)::BIGINT AS duration, l.is_alive, l.executor_logs, l.added_time,
      l.removed_time,
      {", ".join(f"coalesce(t.{c}, 0)::BIGINT AS {c}" for c in METRIC_COLUMNS)},
      l.storage_add_time, l.storage_remove_time, l.max_mem, l.storage_is_alive,
      coalesce(u.mem_used, 0)::BIGINT AS mem_used, coalesce(u.disk_used, 0)::BIGINT AS disk_used
    FROM lifecycle l LEFT JOIN totals t USING (log_id, executor_id)
      LEFT JOIN active a USING (log_id, executor_id)
      LEFT JOIN in_use u USING (log_id, executor_id)""",
    "task_points": f"""SELECT log_id, executor_id, position, end_time AS time,
      {", ".join(f'{SERIES[s]} AS "{s}"' for s in TASK_SERIES)}
    FROM listed""",
    "sample_points": f"""SELECT log_id, executor_id, position, time,
      {", ".join(f'{SERIES[s]} AS "{s}"' for s in STORAGE_SERIES)}
    FROM samples""",
    "app_points": f"""SELECT log_id, executor_id, row_number() OVER (PARTITION BY log_id
        ORDER BY removed_time, first_seen) - 1 AS position,
      {", ".join(f'{e} AS "{s}"' for s, e in SERIES.items())}
    FROM summary""",
    "env": """SELECT log_id, 'jvm' AS scope, 3 AS r, 'Java Version' AS name, '17' AS value FROM span
    UNION ALL SELECT log_id, 'spark', 2, 'spark.app.k', CAST(app AS VARCHAR) FROM span
    UNION ALL SELECT log_id, 'spark', 2, 'shared.key', 'k' || app FROM span
    UNION ALL SELECT log_id, 'system', 1, 'spark.app.k', 'system' FROM span
    UNION ALL SELECT log_id, 'system', 1, 'user.timezone', 'UTC' FROM span""",
    "kinds": """SELECT log_id, 'task' AS family, 'TaskStart' AS event FROM starts
    UNION ALL SELECT log_id, 'task', 'TaskEnd' FROM ends
    UNION ALL SELECT log_id, 'block', 'BlockUpdated' FROM k WHERE event_type = 'click' AND id%4 = 0
    UNION ALL SELECT log_id, 'block', 'UnpersistRDD' FROM drops
    UNION ALL SELECT log_id, 'executor', CASE kind WHEN 'bm+' THEN 'BlockManagerAdded'
      WHEN 'bm-' THEN 'BlockManagerRemoved' WHEN 'ex+' THEN 'ExecutorAdded'
      ELSE 'ExecutorRemoved' END FROM life
    UNION ALL SELECT log_id, 'application', 'ApplicationStart' FROM app_start
    UNION ALL SELECT log_id, 'application', 'ApplicationEnd' FROM app_end
    UNION ALL SELECT log_id, 'application', 'EnvironmentUpdate' FROM span""",
}


def sql(body: str) -> str:
    """``body`` after the CTEs it uses, directly or through others."""
    import re

    def uses(text: str) -> set[str]:
        return {n for n in CTES if re.search(rf"\b{n}\b", text)}

    needed: set[str] = set()
    todo = uses(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= uses(CTES[name]) - {name}
    with_list = ",\n".join(f"{n} AS (\n    {CTES[n]})" for n in CTES if n in needed)
    return f"WITH {with_list}\n{body}"


def _q(name: str) -> str:
    return f'"{name}"'


def _chart(chart: Chart, x: str) -> str:
    """SQL text of one chart specification over the grouped points."""

    def text(json: str) -> str:
        return "'" + json + "'"

    labels = list(chart.lines)
    legend = ",".join(f'"{n}"' for n in labels)
    axes = (
        ",".join(f'{{"name":"{n}","type":"value"}}' for n in labels)
        if chart.own_axes
        else '{"type":"value"}'
    )
    label = f"strftime(make_timestamp({_q(x)}*1000), '%m/%d %H:%M')"
    parts = [
        text(
            f'{{"chartConfig":{{"title":{{"text":"{chart.title}","x":"center"}},'
            f'"legend":{{"data":[{legend}],"x":"left"}},"xAxis":{{"type":"category","data":['
        ),
        f"""coalesce(string_agg('"' || {label} || '"', ',' ORDER BY position), '')""",
        text(f']}},"yAxis":[{axes}],"series":['),
    ]
    for i, (name, column) in enumerate(chart.lines.items()):
        axis = i if chart.own_axes else 0
        parts += [
            text(
                ("," if i else "")
                + f'{{"name":"{name}","type":"line","areaStyle":{{"normal":{{}}}},'
                f'"yAxisIndex":"{axis}","data":['
            ),
            f"coalesce(string_agg({_q(column)}, ',' ORDER BY position), '')",
            text("]}"),
        ]
    parts.append(
        text(
            ']},"width":800,"height":400,"clipRect":{"top":0,"left":0,"width":800,"height":400},'
            '"responseType":"url"}'
        )
    )
    return " || ".join(parts)


def _executor_chart(chart: Chart, points: str) -> str:
    # An executor without points keeps its chart, with empty series, on page 0.
    return (
        f"SELECT s.log_id AS app_id, s.log_id, s.executor_id, "
        f"coalesce(position//10000, 0)::BIGINT AS page, '{chart.title}' AS chart, "
        f"{_chart(chart, 'time')} AS chart_config "
        f"FROM seen s LEFT JOIN {points} p USING (log_id, executor_id) "
        "GROUP BY s.log_id, s.executor_id, coalesce(position//10000, 0)"
    )


def _application_chart(chart: Chart) -> str:
    return (
        f"SELECT log_id AS app_id, log_id, (position//10000)::BIGINT AS page, "
        f"'{chart.title}' AS chart, {_chart(chart, chart.x)} AS chart_config "
        "FROM app_points GROUP BY log_id, position//10000"
    )


def _json(fields: dict) -> str:
    """SQL text of a JSON object over report columns."""

    def value(name: str, source) -> str:
        if isinstance(source, dict):
            return _json(source)
        if source == "executor_logs":
            return "executor_logs"
        return f"coalesce(CAST(to_json({source}) AS VARCHAR), 'null')"

    pairs = " || ',' || ".join(f"""'"{n}":' || {value(n, s)}""" for n, s in fields.items())
    return f"('{{' || {pairs} || '}}')"


_SUMMARY = "SELECT * EXCLUDE (first_seen) FROM summary"
_LISTED = "SELECT log_id AS app_id, * EXCLUDE (start_seq, position) FROM listed"
# Task starts that count in the odd layouts: of the first half of app-0 compaction left every second one.
_ODD_STARTS = """, odd AS (
  SELECT CASE WHEN log_id <> 'app-2' THEN log_id WHEN id % 3 = 0 THEN 'east/app-2' ELSE 'west/app-2' END AS log_id,
         executor_id, id
  FROM starts
  WHERE log_id <> 'app-0' OR id * 4 // ((SELECT max(id) FROM starts) + 1) >= 2 OR id % 2 = 0
)"""
_ODD_ORDER = """SELECT log_id, executor_id, id AS task_id,
  count(*) OVER (PARTITION BY log_id, executor_id ORDER BY id) - 1 AS position FROM odd"""
_TOTAL_EVENTS = "SELECT log_id, family, event, count(*) AS events FROM kinds"

ORACLES = {
    "event_type_counts": sql(
        "SELECT log_id, event, count(*) AS events FROM kinds GROUP BY log_id, event"
    ),
    "parsed_event_counts": sql(f"{_TOTAL_EVENTS} GROUP BY log_id, family, event"),
    "log_lines": sql(
        "SELECT log_id, count(*) AS lines, 0::BIGINT AS corrupt_lines FROM kinds GROUP BY log_id"
    ),
    "application_log": sql(
        "SELECT log_id, event, count(*) AS events FROM kinds WHERE log_id = 'app-1' "
        "GROUP BY log_id, event"
    ),
    "event_order": sql(
        "SELECT log_id, executor_id, id AS task_id, count(*) OVER (PARTITION BY log_id, executor_id "
        "ORDER BY id) - 1 AS position FROM starts"
    ),
    "odd_layout_lines": sql(
        f"{_ODD_STARTS}, torn AS (SELECT * FROM (VALUES ('app-0'), ('west/app-2')) AS t(log_id)) "
        "SELECT log_id, count(*) + (SELECT count(*) FROM torn WHERE torn.log_id = odd.log_id) AS lines, "
        "(SELECT count(*) FROM torn WHERE torn.log_id = odd.log_id) AS corrupt_lines FROM odd GROUP BY log_id"
    ),
    "odd_layout_order": sql(f"{_ODD_STARTS} {_ODD_ORDER}"),
    "streaming_odd_layouts": sql(f"{_ODD_STARTS} {_ODD_ORDER}"),
    "app_timeline": sql("SELECT log_id, max(t)::BIGINT AS timeline FROM clock GROUP BY log_id"),
    "applications": sql(
        "SELECT s.log_id AS app_id, s.log_id, 'job ' || s.app AS app_name, (t0 - 2500)::BIGINT AS "
        "start_time, coalesce((SELECT t FROM app_end e WHERE e.log_id = s.log_id), 0)::BIGINT AS "
        "end_time, (SELECT max(t) FROM clock c WHERE c.log_id = s.log_id)::BIGINT AS timeline "
        "FROM span s"
    ),
    "timeline_as_of": sql(
        "SELECT log_id, timeline, row_number() OVER (PARTITION BY log_id ORDER BY seq) - 1 AS "
        "position FROM as_of"
    ),
    "environment": sql("SELECT log_id AS app_id, log_id, scope, name, value FROM env"),
    "environment_merged": sql(
        "SELECT log_id AS app_id, log_id, name, value FROM env e WHERE r = (SELECT max(r) FROM env "
        "o WHERE o.log_id = e.log_id AND o.name = e.name)"
    ),
    "task_outcomes": sql(
        "SELECT log_id, executor_id, reason, outcome, count(*) AS task_ends FROM ends "
        "GROUP BY log_id, executor_id, reason, outcome"
    ),
    "failure_text": sql(
        "SELECT log_id, executor_id, id AS task_id, reason, outcome, failed_reason, trace_stack "
        "FROM texts WHERE outcome <> 'complete'"
    ),
    "executor_task_totals": sql("SELECT * FROM totals"),
    "task_metrics": sql(
        f"SELECT log_id, task_id, {', '.join(METRIC_COLUMNS)} FROM task"
    ),
    "task_lifecycle": sql(
        "SELECT log_id, task_id, executor_id, start_seq IS NOT NULL AS started, is_alive, "
        "start_time, end_time, duration, failed, killed, failed_reason, trace_stack, "
        "no_finish_time FROM task"
    ),
    "executor_lifecycle": sql(
        "SELECT * EXCLUDE (first_seen), row_number() OVER (PARTITION BY log_id ORDER BY first_seen) "
        "- 1 AS position FROM lifecycle"
    ),
    "active_tasks": sql("SELECT * FROM active"),
    "executor_summary": sql(_SUMMARY),
    "executor_by_id": sql(f"{_SUMMARY} WHERE log_id = 'app-1' AND executor_id = '3'"),
    "executor_shuffle": sql(
        "SELECT log_id AS app_id, log_id, executor_id, task_id, "
        f"{', '.join(SHUFFLE_COLUMNS)} FROM listed"
    ),
    "executor_io": sql(
        "SELECT log_id AS app_id, log_id, executor_id, task_id, "
        f"{', '.join(IO_COLUMNS)} FROM listed"
    ),
    "executor_tasks": sql(_LISTED),
    "tasks_by_executor": sql(
        f"{_LISTED} "
        "WHERE log_id = 'app-1' AND executor_id = '2'"
    ),
    "block_managers": sql(
        "SELECT log_id, executor_id, row_number() OVER (PARTITION BY log_id, executor_id ORDER BY "
        "seq) AS incarnation, t::BIGINT AS add_time, max_mem::BIGINT AS max_mem FROM life "
        "WHERE kind = 'bm+'"
    ),
    "block_incarnations": sql(
        "SELECT log_id, executor_id, incarnation, count(*) AS updates, count(*) FILTER (live) AS "
        "stored_updates, count(*) FILTER (is_last) AS update_events, sum(mem)::BIGINT AS mem, "
        "sum(disk)::BIGINT AS disk FROM stored GROUP BY log_id, executor_id, incarnation"
    ),
    "current_storage": sql("SELECT * FROM in_use"),
    "unpersisted_blocks": sql(
        "SELECT t.log_id, t.executor_id, t.incarnation, t.copies, (SELECT count(*) FROM drops d "
        "WHERE d.log_id = t.log_id AND d.seq < t.seq) AS position FROM touched t"
    ),
    "stored_block_lifetimes": sql(
        "SELECT log_id, executor_id, incarnation, rdd_id::INTEGER AS rdd_id, count(*) AS lifetimes, "
        "sum(met)::BIGINT AS events_met FROM (SELECT s.log_id, s.executor_id, s.incarnation, "
        "s.rdd_id, (SELECT count(*) FROM drops d WHERE d.log_id = s.log_id AND d.rdd_id = s.rdd_id "
        "AND d.seq > s.seq AND d.seq < coalesce((SELECT min(n.seq) FROM stored n WHERE n.log_id = "
        "s.log_id AND n.executor_id = s.executor_id AND n.incarnation = s.incarnation AND "
        "n.block_id = s.block_id AND n.seq > s.seq), 4000000000000000000) AND d.seq < coalesce((SELECT "
        "min(b.seq) FROM life b WHERE b.log_id = s.log_id AND b.executor_id = s.executor_id AND "
        "b.kind = 'bm+' AND b.seq > s.seq), 4000000000000000000)) AS met FROM stored s WHERE s.live) "
        "WHERE met > 0 GROUP BY log_id, executor_id, incarnation, rdd_id"
    ),
    "storage_samples": sql("SELECT log_id AS app_id, * FROM samples"),
    "storage_by_executor": sql(
        "SELECT log_id AS app_id, * FROM samples WHERE log_id = 'app-0' AND executor_id = '1'"
    ),
    "storage_after_release": sql(
        "SELECT l.log_id, l.executor_id, coalesce(l.t, a.timeline)::BIGINT AS time, l.mem_used, "
        "l.disk_used, row_number() OVER (PARTITION BY l.log_id, l.executor_id ORDER BY l.seq, "
        "l.pos) - 1 AS position FROM left_after l LEFT JOIN as_of a USING (log_id, seq)"
    ),
    "executor_task_series": sql("SELECT log_id AS app_id, * FROM task_points"),
    "executor_storage_series": sql("SELECT log_id AS app_id, * FROM sample_points"),
    "application_series": sql("SELECT log_id AS app_id, * FROM app_points"),
    "application_series_long": sql(
        "SELECT log_id AS app_id, log_id, executor_id, position, series, value FROM app_points "
        f"UNPIVOT (value FOR series IN ({', '.join(_q(s) for s in SERIES)}))"
    ),
    "application_charts": sql(
        "\nUNION ALL ".join(_application_chart(c) for c in APPLICATION_CHARTS)
    ),
    "executor_charts": sql(
        "\nUNION ALL ".join(
            [_executor_chart(c, "task_points") for c in TASK_CHARTS]
            + [_executor_chart(STORAGE, "sample_points")]
        )
    ),
    "executor_json": sql(
        f"SELECT app_id, log_id, executor_id, {_json(EXECUTOR_JSON)} AS json FROM summary"
    ),
    "task_json": sql(
        f"SELECT log_id AS app_id, log_id, executor_id, task_id, {_json(TASK_JSON)} AS json "
        "FROM listed"
    ),
    "storage_json": sql(
        "SELECT log_id AS app_id, log_id, executor_id, position, '{\"time\":' || time || "
        "',\"memUsed\":' || mem_used || ',\"diskUsed\":' || disk_used || '}' AS json FROM samples"
    ),
    "streaming_executor_totals": sql("SELECT * FROM totals"),
    "streaming_executors": sql(
        "SELECT * EXCLUDE (app_id, first_seen, mem_used, disk_used) FROM summary"
    ),
    "streaming_storage_samples": sql("SELECT * FROM samples"),
    "block_manager_json": sql(
        "SELECT log_id AS app_id, log_id, executor_id, '{\"executorId\":\"' || executor_id || "
        "'\",\"addTime\":' || arg_max(t, seq) || '}' AS json FROM life WHERE kind = 'bm+' "
        "GROUP BY log_id, executor_id"
    ),
}
