"""Random event logs full of odd cases."""

import json
import random
from emberlog.sources.schema import EVENT_PREFIX

LEVEL = {"Use Disk": True, "Use Memory": True, "Deserialized": False, "Replication": 1}
NONE = {"Use Disk": False, "Use Memory": False, "Deserialized": False, "Replication": 1}


def reason(rng):
    kind = rng.choice(
        ["Success"] * 6
        + ["Resubmitted", "ExceptionFailure", "ExecutorLostFailure", "FetchFailed"]
        + ["TaskCommitDenied", "TaskKilled", "TaskResultLost", "UnknownReason"]
    )
    n = rng.randrange(100)
    if kind == "Resubmitted":
        return {"Reason": kind, "text": "Resubmitted (resubmitted due to lost executor)"}
    if kind == "ExceptionFailure":
        return {
            "Reason": kind,
            "Class Name": "E",
            "Description": f"d{n}",
            "Full Stack Trace": f"E: d{n}\n\tat x",
            "text": f"d{n}",
        }
    if kind == "ExecutorLostFailure":
        out = {"Reason": kind, "Executor ID": "7", "Exit Caused By App": n % 2 == 0}
        how = "caused by one of" if n % 2 == 0 else "unrelated to"
        out["text"] = f"ExecutorLostFailure (executor 7 exited {how} the running tasks)"
        if n % 3 == 0:
            out["Loss Reason"] = f"r{n}"
            out["text"] += f" Reason: r{n}"
        return out
    if kind == "FetchFailed":
        out = {"Reason": kind, "Shuffle ID": 1, "Map ID": 2, "Reduce ID": 3, "Message": f"m{n}"}
        where, index = "null", ""
        if n % 2 == 0:
            out["Block Manager Address"] = {"Executor ID": "7", "Host": "h", "Port": 9}
            where = "BlockManagerId(7, h, 9, None)"
        if n % 3 == 0:
            out["Map Index"] = 4
            index = "mapIndex=4, "
        out["text"] = (
            f"FetchFailed({where}, shuffleId=1, {index}mapId=2, reduceId=3, message=\nm{n}\n)"
        )
        return out
    if kind == "TaskCommitDenied":
        return {
            "Reason": kind,
            "Job ID": n,
            "Partition ID": 2,
            "Attempt Number": 3,
            "text": "TaskCommitDenied (Driver denied task commit) for job: "
            f"{n}, partition: 2, attemptNumber: 3",
        }
    if kind == "TaskKilled" and n % 2:
        return {"Reason": kind, "Kill Reason": "another attempt succeeded"}
    return {"Reason": kind}


def status(rng):
    none = rng.random() < 0.25
    size = (lambda: 0) if none else (lambda: rng.choice([0, rng.randrange(1, 50)]))
    return {"Storage Level": NONE if none else LEVEL, "Memory Size": size(), "Disk Size": size()}


def block(rng):
    return rng.choice(
        [f"rdd_{rng.randrange(3)}_{rng.randrange(3)}", f"broadcast_{rng.randrange(2)}"]
    )


def metrics(rng):
    n = lambda: rng.randrange(1000)
    out = {
        "Executor Deserialize Time": n(), "Executor Run Time": n(), "Result Size": n(),
        "JVM GC Time": n(), "Result Serialization Time": n(), "Memory Bytes Spilled": n(),
        "Disk Bytes Spilled": n(),
    }
    if rng.random() < 0.8:
        out["Executor CPU Time"] = n()
    if rng.random() < 0.8:
        out["Shuffle Read Metrics"] = {
            "Remote Blocks Fetched": n(), "Local Blocks Fetched": n(), "Fetch Wait Time": n(),
            "Remote Bytes Read": n(), "Local Bytes Read": n(), "Total Records Read": n(),
        }
        out["Shuffle Write Metrics"] = {
            "Shuffle Bytes Written": n(), "Shuffle Write Time": n(), "Shuffle Records Written": n(),
        }
        out["Input Metrics"] = {"Bytes Read": n(), "Records Read": n()}
        out["Output Metrics"] = {"Bytes Written": n(), "Records Written": n()}
    if rng.random() < 0.5:
        out["Updated Blocks"] = [
            {"Block ID": block(rng), "Status": status(rng)} for _ in range(rng.randrange(3))
        ]
    return out


def random_log(seed, length):
    rng = random.Random(seed)
    executors = ["driver", "<driver>", "1", "2", "3", "4"]
    time = lambda: rng.randrange(1, 100_000)
    events, next_task, started = [], 0, []
    ended = False
    for i in range(length):
        x = rng.choice(executors)
        kind = rng.choices(
            ["ExecutorAdded", "ExecutorRemoved", "TaskStart", "TaskEnd", "BlockManagerAdded",
             "BlockManagerRemoved", "BlockUpdated", "UnpersistRDD", "ApplicationStart",
             "ApplicationEnd", "EnvironmentUpdate", "StageSubmitted"],
            [2, 1, 20, 20, 3, 1, 15, 4, 1, 0.3, 0.5, 2],
        )[0]
        e = {"Event": f"{EVENT_PREFIX}{kind}"}
        if kind == "ExecutorAdded":
            e |= {"Timestamp": time(), "Executor ID": x}
            e["Executor Info"] = {"Total Cores": rng.randrange(9), "Log Urls": {"u": f"{i}"}}
        elif kind == "ExecutorRemoved":
            e |= {"Timestamp": time(), "Executor ID": x}
        elif kind == "TaskStart":
            start = time()
            e |= {"Stage ID": rng.randrange(9)}
            e["Task Info"] = {
                "Task ID": next_task, "Launch Time": start, "Executor ID": x, "Finish Time": 0,
            }
            started.append((next_task, x, start))
            next_task += 1
        elif kind == "TaskEnd":
            if rng.random() < 0.03:
                e |= {"Task End Reason": {"Reason": "Success"}}
            else:
                if started and rng.random() < 0.85:
                    tid, x, start = rng.choice(started)
                else:
                    tid, start = 100_000 + i, time()
                e |= {"Stage ID": 0, "Task End Reason": reason(rng)}
                e["Task Info"] = {
                    "Task ID": tid, "Launch Time": start, "Executor ID": x,
                    "Finish Time": start + rng.randrange(500),
                }
                if rng.random() < 0.85:
                    e["Task Metrics"] = metrics(rng)
        elif kind == "BlockManagerAdded":
            e |= {"Timestamp": time(), "Maximum Memory": rng.randrange(1000)}
            e["Block Manager ID"] = {"Executor ID": x, "Host": "h", "Port": 1}
        elif kind == "BlockManagerRemoved":
            e |= {"Timestamp": time()}
            e["Block Manager ID"] = {"Executor ID": x, "Host": "h", "Port": 1}
        elif kind == "BlockUpdated":
            e["Block Updated Info"] = {
                "Block Manager ID": {"Executor ID": x, "Host": "h", "Port": 1},
                "Block ID": block(rng),
                **status(rng),
            }
        elif kind == "UnpersistRDD":
            e["RDD ID"] = rng.randrange(3)
        elif kind == "ApplicationStart":
            if any(p["Event"] == f"{EVENT_PREFIX}ApplicationStart" for p in events):
                continue
            e |= {"Timestamp": time(), "App ID": f"app {seed}", "App Name": "n"}
            if rng.random() < 0.7:
                e["Driver Logs"] = {"d": f"{i}"}
        elif kind == "ApplicationEnd":
            if ended:
                continue
            ended = True
            e |= {"Timestamp": time()}
        elif kind == "EnvironmentUpdate":
            e["JVM Information"] = {"a": f"j{i}"}
            e["Spark Properties"] = {"a": "s", "b": f"s{i}"}
            e["System Properties"] = {"a": "y", "b": "y", "c": f"y{i}"}
        events.append(e)
    return events


def lines(events):
    for e in events:
        out = dict(e)
        if "Task End Reason" in out:
            out["Task End Reason"] = {
                k: v for k, v in out["Task End Reason"].items() if k != "text"
            }
        yield json.dumps(out, separators=(",", ":"))
