"""A plain event-at-a-time model of one log, the yardstick for the Spark folds."""

from collections import defaultdict

from emberlog.sources.schema import EVENT_PREFIX

# Fixed values, stated here again so that a wrong entry in the package shows.
FAILED_REASONS = (
    "Resubmitted",
    "ExceptionFailure",
    "ExecutorLostFailure",
    "FetchFailed",
    "TaskCommitDenied",
)
LOGGED_METRICS = {
    "executor_cpu_time": "`Executor CPU Time`",
    "executor_run_time": "`Executor Run Time`",
    "jvm_gc_time": "`JVM GC Time`",
    "result_size": "`Result Size`",
    "disk_bytes_spilled": "`Disk Bytes Spilled`",
    "memory_bytes_spilled": "`Memory Bytes Spilled`",
    "result_serialization_time": "`Result Serialization Time`",
    "executor_deserialize_time": "`Executor Deserialize Time`",
    "input_bytes": "`Input Metrics`.`Bytes Read`",
    "input_records": "`Input Metrics`.`Records Read`",
    "output_bytes": "`Output Metrics`.`Bytes Written`",
    "output_records": "`Output Metrics`.`Records Written`",
    "shuffle_wait": "`Shuffle Read Metrics`.`Fetch Wait Time`",
    "remote_blocks_fetched": "`Shuffle Read Metrics`.`Remote Blocks Fetched`",
    "local_blocks_fetched": "`Shuffle Read Metrics`.`Local Blocks Fetched`",
    "remote_bytes_read": "`Shuffle Read Metrics`.`Remote Bytes Read`",
    "local_bytes_read": "`Shuffle Read Metrics`.`Local Bytes Read`",
    "records_read": "`Shuffle Read Metrics`.`Total Records Read`",
    "shuffle_bytes_written": "`Shuffle Write Metrics`.`Shuffle Bytes Written`",
    "shuffle_records_written": "`Shuffle Write Metrics`.`Shuffle Records Written`",
    "write_time": "`Shuffle Write Metrics`.`Shuffle Write Time`",
}
# Beside the logged ones: two sums, and one that is never filled.
METRIC_COLUMNS = [*LOGGED_METRICS, "total_blocks_fetched", "total_bytes_read", "shuffle_record_write"]


def dig(event, path):
    for key in path.strip("`").split("`.`"):
        event = (event or {}).get(key)
    return event or 0


def metrics_of(event):
    logged = event.get("Task Metrics")
    if logged is None:
        return dict.fromkeys(METRIC_COLUMNS, 0)
    out = {name: dig(logged, path) for name, path in LOGGED_METRICS.items()}
    out["total_blocks_fetched"] = out["remote_blocks_fetched"] + out["local_blocks_fetched"]
    out["total_bytes_read"] = out["remote_bytes_read"] + out["local_bytes_read"]
    out["shuffle_record_write"] = 0
    return out


def is_none(level):
    flags = ("Use Disk", "Use Memory", "Use Off Heap", "Deserialized")
    return not any(level.get(f) for f in flags) and level["Replication"] == 1


class Model:
    """State of one log after feeding its events in order."""

    def __init__(self, unpersist="keep"):
        self.executors = {}
        self.tasks = {}
        self.managers = {}
        self.clock = -1
        self.samples = defaultdict(list)
        self.unpersist = unpersist

    def executor(self, eid):
        return self.executors.setdefault(
            eid,
            {
                "stage_id": 0, "total_cores": 0, "tasks_active": 0, "tasks_failed": 0,
                "tasks_complete": 0, "duration": 0, "is_alive": True, "executor_logs": {},
                "added_time": 0, "removed_time": 0, "storage_add_time": 0,
                "storage_remove_time": 0, "max_mem": 0, "storage_is_alive": True,
                "mem_used": 0, "disk_used": 0, "list": [],
                **dict.fromkeys(METRIC_COLUMNS, 0),
            },
        )

    def task(self, tid):
        return self.tasks.setdefault(
            tid,
            {
                "is_alive": True, "start_time": 0, "end_time": 0, "duration": 0,
                "failed": False, "killed": False, "failed_reason": None, "trace_stack": None,
                **dict.fromkeys(METRIC_COLUMNS, 0),
            },
        )

    def tick(self, time):
        self.clock = max(self.clock, time)

    def feed(self, event):
        getattr(self, event["Event"].removeprefix(EVENT_PREFIX), lambda e: None)(event)

    def ExecutorAdded(self, e):
        x, info = self.executor(e["Executor ID"]), e["Executor Info"]
        x.update(
            executor_logs=info["Log Urls"], total_cores=info["Total Cores"],
            added_time=e["Timestamp"], storage_add_time=e["Timestamp"],
        )
        self.tick(e["Timestamp"])

    def ExecutorRemoved(self, e):
        if x := self.executors.get(e["Executor ID"]):
            x.update(
                is_alive=False, removed_time=e["Timestamp"], storage_remove_time=e["Timestamp"]
            )
        self.tick(e["Timestamp"])

    def BlockManagerAdded(self, e):
        eid, time = e["Block Manager ID"]["Executor ID"], e["Timestamp"]
        x = self.executor(eid)
        self.managers[eid] = {}
        x["added_time"] = x["added_time"] or time
        x.update(max_mem=e["Maximum Memory"], storage_add_time=time, storage_is_alive=True)
        self.tick(time)

    def BlockManagerRemoved(self, e):
        if x := self.executors.get(e["Block Manager ID"]["Executor ID"]):
            x.update(storage_remove_time=e["Timestamp"], storage_is_alive=False)
        self.tick(e["Timestamp"])

    def ApplicationStart(self, e):
        driver = next((m for m in self.managers if m in ("driver", "<driver>")), None)
        if e.get("Driver Logs") is not None and driver:
            self.executor(driver).update(
                executor_logs=e["Driver Logs"], added_time=e["Timestamp"]
            )
        self.tick(e["Timestamp"])

    def ApplicationEnd(self, e):
        for x in self.executors.values():
            if x["removed_time"] == 0:
                x.update(
                    removed_time=e["Timestamp"], is_alive=False, storage_is_alive=False,
                    storage_remove_time=e["Timestamp"],
                )
        self.tick(e["Timestamp"])

    def TaskStart(self, e):
        info = e["Task Info"]
        x, t = self.executor(info["Executor ID"]), self.task(info["Task ID"])
        x["tasks_active"] += 1
        x["stage_id"] = e["Stage ID"]
        x["list"].append(info["Task ID"])
        t["start_time"] = info["Launch Time"]
        self.tick(info["Launch Time"])

    def TaskEnd(self, e):
        info, why = e.get("Task Info"), e["Task End Reason"]
        if info is None:
            return
        x, t = self.executor(info["Executor ID"]), self.task(info["Task ID"])
        if why["Reason"] in FAILED_REASONS:
            x["tasks_failed"] += 1
            t["failed"] = True
            t["failed_reason"] = why["text"]
            if why["Reason"] == "ExceptionFailure":
                t["trace_stack"] = why["Full Stack Trace"]
        elif why["Reason"] == "TaskKilled":
            t["killed"] = True
        else:
            x["tasks_complete"] += 1
        x["tasks_active"] = max(0, x["tasks_active"] - 1)
        took = info["Finish Time"] - info["Launch Time"]
        x["duration"] += took
        t.update(is_alive=False, end_time=info["Finish Time"], duration=took)
        for name, value in metrics_of(e).items():
            x[name] += value
            t[name] += value
        blocks = (e.get("Task Metrics") or {}).get("Updated Blocks") or []
        if blocks:
            changes = [(b["Block ID"], b["Status"]) for b in blocks]
            self.store(info["Executor ID"], info["Finish Time"], changes)
        self.tick(info["Finish Time"])

    def BlockUpdated(self, e):
        u = e["Block Updated Info"]
        eid = u["Block Manager ID"]["Executor ID"]
        if eid in self.executors:
            self.store(eid, self.clock, [(u["Block ID"], u)])

    def UnpersistRDD(self, e):
        mine = f"rdd_{e['RDD ID']}_"
        for eid, blocks in self.managers.items():
            for block in sorted(b for b in blocks if b.startswith(mine)):
                if self.unpersist == "release":
                    del blocks[block]
                self.sample(eid, self.clock)

    def store(self, eid, time, changes):
        if eid not in self.managers:
            return
        for block, status in changes:
            if is_none(status["Storage Level"]):
                self.managers[eid].pop(block, None)
            else:
                self.managers[eid][block] = (status["Memory Size"], status["Disk Size"])
        self.sample(eid, time)

    def sample(self, eid, time):
        held = self.managers[eid].values()
        mem, disk = sum(m for m, _ in held), sum(d for _, d in held)
        self.executor(eid).update(mem_used=mem, disk_used=disk)
        self.samples[eid].append((time, mem, disk))


def fold(events, unpersist="keep"):
    model = Model(unpersist)
    for event in events:
        model.feed(event)
    return model
