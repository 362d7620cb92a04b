"""The inbox source, the feed sink and keyed state: several batches, restarts, failures, both clocks."""

import json
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rallylake.sources import inbox
from rallylake.streaming import state, tracking

HOUR = 3_600_000_000
BASE = 1_700_000_000_000_000


@pytest.fixture
def places(tmp_path):
    return SimpleNamespace(inbox=f"{tmp_path}/inbox", progress=f"{tmp_path}/progress", out=f"{tmp_path}/out", log=f"{tmp_path}/log")


def send(spark, places, rows, deliveries=1, first=0, producer="all"):
    df = spark.createDataFrame([(k, json.dumps(r) if isinstance(r, dict) else r) for k, r in enumerate(rows)], "k int, body string")
    inbox.deliver(df, places.inbox, ["k"], deliveries, producer, first)


def read(spark, places, schema, most=1):
    rows = inbox.messages(spark, places.inbox, most=most, progress=places.progress)
    return rows.select(F.from_json("body", schema).alias("m")).select("m.*")


def test_inbox_restart_loses_and_repeats_nothing(spark, places):
    for n, producer in enumerate(("a", "b c/d")):
        send(spark, places, [f"{producer} {k}" for k in range(40)], 4 + n, producer=producer)
    fail = {"at": 1}

    def put(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{places.out}/batch={batch_id}")
        if batch_id == fail.get("at"):
            fail.clear()
            raise RuntimeError("lost after writing")

    def go():
        query = inbox.messages(spark, places.inbox, most=1, progress=places.progress).writeStream.foreachBatch(put).option("checkpointLocation", places.log).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    with pytest.raises(Exception, match="lost after writing"):
        go()
    go()
    send(spark, places, [f"a {k}" for k in range(40, 50)], 2, first=4, producer="a")
    go()
    rows = spark.read.parquet(places.out).collect()
    assert sorted(r["body"] for r in rows) == sorted([f"a {k}" for k in range(50)] + [f"b c/d {k}" for k in range(40)])
    assert len({r["batch"] for r in rows}) > 4
    # a delivery of one producer never comes before an earlier one
    for p in {r["producer"] for r in rows}:
        order = [r["seq"] for r in sorted((r for r in rows if r["producer"] == p), key=lambda r: (r["batch"], r["seq"]))]
        assert order == sorted(order)


def test_inbox_offsets_never_go_back(tmp_path):
    (tmp_path / "producer=x" / "seq=3").mkdir(parents=True)
    (tmp_path / "producer=x" / "seq=3" / "part").write_bytes(b"one\ntwo \xff\nthree")
    (tmp_path / "producer=x" / "_temporary").mkdir()
    reader = inbox.InboxReader({"path": str(tmp_path)})
    assert reader.latestOffset() == {"x": 3} and len(reader.partitions({"x": 1}, {"x": 3})) == 2
    assert [r["body"] for p in reader.partitions({}, {"x": 3}) for b in reader.read(p) for r in b.to_pylist()] == ["one", "two �", "three"]
    with pytest.raises(ValueError, match="went back"):
        reader.partitions({"x": 4}, {"x": 3})
    assert inbox.InboxReader({"path": f"{tmp_path}/none"}).latestOffset() == {}
    slow = inbox.InboxReader({"path": str(tmp_path), "most": "2", "progress": f"{tmp_path}/p.json"})
    assert [slow.latestOffset() for _ in range(3)] == [{"x": 1}, {"x": 3}, {"x": 3}]
    assert inbox.InboxReader({"path": str(tmp_path), "most": "2", "progress": f"{tmp_path}/p.json"}).latestOffset() == {"x": 3}


def test_messages_are_judged(spark, places):
    bodies = ['{"jobId":"a","status":"running","progress":5,"at":7}', '{"jobId":0,"status":"running"}', '{"jobId":"","status":"running"}', '{"jobId":"b"}', '{"jobId":"b","status":"paused"}', '{"jobId":', "[1]", '{"jobId":false,"status":"x"}', '{"jobId":12,"status":"failed","x":{"y":1}}', "null", "", '{"jobId":"0","status":"queued"}']
    send(spark, places, bodies)
    state.run(inbox.judged(inbox.messages(spark, places.inbox)), places.out, places.log)
    found = [(r["reason"], r["job_id"], r["status"]) for r in spark.read.parquet(places.out).orderBy("line").collect()]
    assert found == [
        (None, "a", "running"), ("missing job", "0", "running"), ("missing job", "", "running"), ("missing status", "b", None), ("unknown status", "b", "paused"), ("unreadable", None, None), ("unreadable", None, None),
        ("missing job", "false", "x"), (None, "12", "failed"), ("unreadable", None, None), ("unreadable", None, None), (None, "0", "queued"),
    ]


def fold(rows, retention, until=None):
    """(spans wiped, rows left) by job; a timer wipes what came before it. ``until`` is where the clock stands at the end."""
    out = {}
    for job in {r["job_id"] for r in rows}:
        log, due, wiped = [], [], []

        def fire(now):
            while due and due[0] <= now:  # noqa: B023
                due.pop(0)  # noqa: B023
                if log:  # noqa: B023
                    wiped.append(len(log))  # noqa: B023
                    log.clear()  # noqa: B023

        for r in sorted((r for r in rows if r["job_id"] == job), key=lambda r: (r["at"], r["id"])):
            fire(r["at"])
            log.append(r)
            if r["status"] in state.TERMINAL:
                due.append(r["at"] + retention)
        if until is not None:
            fire(until)
        out[job] = (sorted(wiped), len(log))
    return out


SCHEMA = "job_id string, at long, id long, status string"


def outcome(spark, places, rows):
    wiped, left = {}, {}
    for r in spark.read.schema(state.JobLog.OUT).parquet(places.out).collect():
        wiped.setdefault(r["job_id"], []).append(r["wiped"])
    for r in state.held(spark, places.log).groupBy("job_id").count().collect():
        left[r["job_id"]] = r["count"]
    return {job: (sorted(wiped.get(job, [])), left.get(job, 0)) for job in {r["job_id"] for r in rows}}


@pytest.mark.parametrize("deliveries", [1, 7])
def test_job_logs_expire_by_event_time_over_restarts(spark, places, deliveries):
    rng = random.Random(deliveries)
    rows = [{"job_id": str(rng.randrange(6)), "at": BASE + rng.randrange(0, 40 * HOUR), "id": k, "status": rng.choice(["queued", "running", "running", "completed", "failed"])} for k in range(300)]
    # two terminal updates 40 minutes apart and others after each; two updates at one time
    rows += [{"job_id": "x", "at": BASE + m * HOUR // 60, "id": 1000 + m, "status": s} for m, s in [(0, "running"), (10, "failed"), (50, "completed"), (60, "queued"), (75, "queued"), (80, "running"), (111, "running"), (300, "running")]]
    rows += [{"job_id": "x", "at": BASE + 300 * HOUR // 60, "id": 999, "status": "running"}]
    rows.sort(key=lambda r: (r["at"], r["id"]))
    half = len(rows) // 2
    for part, first in ((rows[:half], 0), (rows[half:], deliveries)):  # the second run goes on from the state of the first
        send(spark, places, part, deliveries, first)
        state.run(state.expiring(read(spark, places, SCHEMA)), places.out, places.log)
    # the watermark has whole milliseconds
    until = (max(r["at"] for r in rows) // 1000 - 600_000) * 1000
    assert outcome(spark, places, rows) == fold(rows, HOUR, until)


def test_job_logs_expire_by_arrival_over_restarts(spark, places):
    go = lambda: state.run(state.expiring(read(spark, places, SCHEMA), "processing", 2_000), places.out, places.log, idle=False)
    first = [{"job_id": j, "at": 0, "id": k, "status": s} for k, (j, s) in enumerate([("a", "running"), ("a", "failed"), ("b", "running"), ("c", "completed")])]
    second = [{"job_id": j, "at": 0, "id": 10 + k, "status": "running"} for k, j in enumerate("aabd")]
    send(spark, places, first)
    go()
    assert outcome(spark, places, first) == {"a": ([], 2), "b": ([], 1), "c": ([], 1)}
    time.sleep(2.5)
    send(spark, places, second, first=1)
    go()
    # what came before the timers is gone, what arrived after them stays
    assert outcome(spark, places, first + second) == {"a": ([2], 2), "b": ([], 2), "c": ([1], 0), "d": ([], 1)}


def test_metered_minutes_pass_from_run_to_run(spark, places):
    rng, used, want = random.Random(1), {}, {}
    rows = [{"key": str(rng.randrange(4)), "at": k // 2, "id": k, "minutes": rng.choice([None, 10, 50, 120]), "included": None if k % 50 == 0 else 300} for k in range(200)]
    for r in rows:
        now, most = used.get(r["key"], 0), r["included"]
        fits = most is None or now + (r["minutes"] or 0) - most <= 600
        used[r["key"]] = now + (r["minutes"] or 0) * fits
        want[r["id"]] = (fits, used[r["key"]], None if most is None else max(0, most - used[r["key"]]), None if most is None else max(0, used[r["key"]] - most))
    schema = "key string, at long, id long, minutes long, included long"
    both = {"accepted": F.col("accepted"), "rejected": ~F.col("accepted")}
    for at in (0, 100):
        send(spark, places, rows[at : at + 100], 3, first=at)  # numbers with a gap
        for _ in range(2):  # a run without news changes nothing
            state.run_apart(state.metered(read(spark, places, schema, 50), 600), both, places.out, places.log)
    got = {name: spark.read.parquet(f"{places.out}/{name}").collect() for name in both}
    assert all(r["accepted"] == (name == "accepted") for name, part in got.items() for r in part) and got["rejected"]
    assert {r["id"]: (r["accepted"], r["used"], r["remaining"], r["overage"]) for part in got.values() for r in part} == want
    assert sum(map(len, got.values())) == len(rows)


def test_feeds_of_subscribers(spark, places):
    rows = [("j", 1, 1, "queued", None), ("j", 2, None, None, "early"), ("j", 3, 2, "running", None), ("j", 3, None, None, "late"), ("j", 4, 3, "completed", None), ("j", 5, 4, "running", None), ("j", 6, None, None, "after"), ("k", 1, None, None, "alone"), ("j", 7, 5, "failed", None), ("j", 8, None, None, "again")]
    names = ["job_id", "at", "id", "status", "subscriber"]
    spark.dataSource.register(inbox.Feeds)
    for k, row in enumerate(sorted(rows, key=lambda r: r[1])):  # a run for each row: all passes through the state
        send(spark, places, [dict(zip(names, row, strict=True))], first=k)
        if k % 3 == 2 or k == len(rows) - 1:
            state.run(state.feeds(read(spark, places, SCHEMA + ", subscriber string")), places.out, places.log, sink="feeds")
    got = {}
    for r in sorted(spark.read.schema(inbox.FRAME).json(f"{places.out}/batch=*").collect(), key=lambda r: (r["subscriber"], r["place"])):
        got.setdefault(r["subscriber"], []).append(r["frame"])
    assert got == {
        "early": ["connected", "1 queued", "2 running", "3 completed", "end"], "late": ["connected", "2 running", "3 completed", "end"],
        "after": ["connected", "4 running", "5 failed", "end"], "alone": ["connected"], "again": ["connected", "5 failed"],
    }


def test_the_sink_commits_in_two_phases(tmp_path):
    frame = lambda k: SimpleNamespace(asDict=lambda: {"subscriber": "s", "place": k, "frame": "é"})
    writer, there = inbox.FeedWriter({"path": str(tmp_path)}), lambda: sorted(str(x.relative_to(tmp_path)) for x in tmp_path.rglob("*.json"))
    lost = writer.write(iter([frame(0)]))
    assert there() == [f"_aside/{lost.name}"]  # not visible before the commit
    writer.abort([lost, None, inbox.Staged(None)], 0)
    assert there() == []
    for _ in range(2):  # a batch that is tried again replaces itself
        done = [writer.write(iter([frame(1), frame(2)])), writer.write(iter([]))]
        writer.commit(done, 0)
        assert there() == [f"batch=0/{done[0].name}"]
    assert [json.loads(x)["place"] for x in (tmp_path / there()[0]).read_text().splitlines()] == [1, 2]
    writer.commit([inbox.Staged(None)], 1)
    assert len(there()) == 1


def test_out_of_order_payments_meet_over_batches(spark, places):
    rows = [(1, 0, "signup"), (2, 3, "purchase"), (3, 2000, "purchase"), (4, 2001, "signup"), (5, 100_000, "purchase"), (6, 100_005, "signup")]
    send(spark, places, [{"event_id": i, "user_id": 7, "at": 1_700_000_000_000_000 + s * 1_000_000, "event_type": k} for i, s, k in rows], 3)
    stream = read(spark, places, "user_id long, at long, event_id long, event_type string").withColumn("ts", F.timestamp_micros("at"))
    state.run(tracking.matched(stream), places.out, places.log)
    assert {tuple(r) for r in spark.read.schema("first_id long, then_id long").parquet(places.out).collect()} == {(1, 2), (1, 3), (4, 3)}


def test_batches_do_not_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from rallylake.plans import streams

    monkeypatch.setattr(streams, "MOST", 50)
    monkeypatch.setattr(streams, "PIECE", 40)
    rows = spark.range(400).selectExpr("id", "id % 40 AS key", "CAST(id AS STRING) AS body")
    # no key has more than its bound, so there are two deliveries of several files, whatever the rows
    dealt = streams.deal(rows, "key")
    assert dealt == {"deliveries": 2, "pieces": 5}
    # one key has: no delivery holds more than about the bound
    assert streams.deal(rows.withColumn("key", F.when(F.col("id") < 60, -1).otherwise(F.col("key"))), "key")["deliveries"] == 16
    assert streams.deal(rows.where("false"), "key") == {"deliveries": 2, "pieces": 1}
    inbox.deliver(rows, f"{tmp_path}/inbox", ["id"], **dealt)
    reader = inbox.InboxReader({"path": f"{tmp_path}/inbox"})
    end = reader.latestOffset()
    assert end == {"all": 1}
    # a task a file, and lines that rise through a delivery
    parts = reader.partitions({}, end)
    assert len(parts) == 10
    found = [(r["seq"], r["line"], int(r["body"])) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(x[2] for x in found) == list(range(400))
    assert [x[2] for x in sorted(found)] == list(range(400))
    assert len({x[:2] for x in found}) == 400


def test_a_key_has_one_timer_at_a_time():
    """Due times of a key fire from the first timer that is due, which arms the next one."""

    class Listed(list):
        def get(self):
            return iter(list(self))

        def exists(self):
            return bool(self)

        def put(self, rows):
            self[:] = rows

        def appendList(self, rows):
            self.extend(rows)

    log, due, armed = Listed(), Listed(), []
    job = state.JobLog("event")
    job.init(SimpleNamespace(getListState=lambda name, schema: {"log": log, "due": due}[name], registerTimer=armed.append))
    row = lambda k: SimpleNamespace(at=k * HOUR, id=k, status="completed")
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0, getCurrentWatermarkInMs=lambda: 4 * HOUR // 1000)
    list(job.handleInputRows(("a",), iter([row(k) for k in (2, 1, 3, 4, 5)]), clock))
    assert armed == [2 * HOUR // 1000]
    out = list(job.handleExpiredTimer(("a",), clock, SimpleNamespace(getExpiryTimeInMs=lambda: armed[0])))
    assert [(r["fired"], r["wiped"]) for r in out] == [(2 * HOUR, 1), (3 * HOUR, 1), (4 * HOUR, 1)]
    assert armed == [2 * HOUR // 1000, 5 * HOUR // 1000] and len(log) == 2 and len(due) == 2


def test_a_watch_waits_for_a_batch_that_takes_long(spark, places):
    def slow(batches):
        time.sleep(12)
        yield from batches

    send(spark, places, ["a", "b"])
    push = inbox.messages(spark, places.inbox).select("body").mapInArrow(slow, "body string")
    rows, how = tracking.watched(push, lambda x: x.count() == 2, "slow-watch", every="200 milliseconds", quiet_s=6, timeout_s=60)
    assert (how, rows.count()) == ("done", 2)


def test_what_is_due_by_a_jobs_own_updates_is_wiped_on_arrival():
    """A batch of many hours leaves the last ones in the state only, and what was held before fires with them."""

    class Listed(list):
        get = list.__iter__
        appendList = list.extend

        def put(self, rows):
            self[:] = rows

    log, due, armed, dropped = Listed(), Listed(), [], []
    job = state.JobLog("event", delay_ms=600_000)
    job.init(SimpleNamespace(getListState=lambda name, schema: {"log": log, "due": due}[name], registerTimer=armed.append, deleteTimer=dropped.append))
    clock = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 0, getCurrentWatermarkInMs=lambda: 0)
    rows = [{"job_id": "a", "at": BASE + m * HOUR // 60, "id": m, "status": "completed" if m % 30 == 0 else "running"} for m in range(0, 3000, 10)]
    out, sizes = [], []
    for part in (rows[:1], rows[1:200], rows[200:201], rows[201:]):
        out += job.handleInputRows(("a",), iter([SimpleNamespace(**r) for r in part]), clock)
        sizes.append((len(log), len(due)))
    until = rows[-1]["at"] - 600_000_000
    assert (sorted(r["wiped"] for r in out), len(log)) == fold(rows, HOUR, until)["a"]
    assert sizes[0] == (1, 1) and max(sizes) <= (10, 3) and set(armed) - set(dropped) == {-(-due[0][0] // 1000)}
