"""Streams against their batch twins, restarts and repeats, and the key state machine against a model that scans."""

import random
import tempfile
from types import SimpleNamespace

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from flowlens.config import DEFAULT
from flowlens.operators import discovery as D
from flowlens.session import materialize
from flowlens.sources import fixtures as fx
from flowlens.streaming import state as S
from flowlens.streaming import stream as ST

DAY = 86_400_000_000


def folder(name):
    return tempfile.mkdtemp(prefix=f"flowlens-{name}-", dir="/tmp")


def norm(df):
    return sorted(tuple(str(x) for x in r) for r in df.select(*D.DISCOVERED_COLS).collect())


@pytest.fixture(scope="module")
def log(spark):
    d = folder("log")
    fx.flows(spark, SF_SMALL).withColumn("day", F.to_date("start_time")).repartition("day") \
        .write.partitionBy("day").parquet(f"{d}/flows")
    return f"{d}/flows"


def wanted(spark, log, until):
    return norm(materialize(ST.replay_batch(spark.read.parquet(log).drop("day"), DEFAULT, until=until), "replay"))


def govern(spark, base):
    ST.govern(spark, base, f"{base}/govern", DEFAULT).awaitTermination()
    return S.discovered(spark, f"{base}/govern")


# ------------------------------------------------------------------------------------------- discovery

def test_replay_equals_batch_over_restarts_and_repeats(spark, log):
    base = folder("replay")
    run = lambda **kw: ST.replay(spark, log, base, f"{base}/replay", DEFAULT, **kw)
    from datetime import datetime
    assert run(days_per_batch=4, until=datetime(2024, 1, 9)) == datetime(2024, 1, 9)
    govern(spark, base)
    end = run(days_per_batch=11)
    got = norm(govern(spark, base))
    assert got == wanted(spark, log, end) and len(got) > 0
    assert ST.pipelines(spark, base).where(F.col("pipeline") == ST.DISCOVERY).first()["last_watermark_end"] == end
    hits = ST.pipelines(spark, base).first()["records"]
    assert hits == sum(int(r[D.DISCOVERED_COLS.index("hit_count")]) for r in got)
    # a batch that a crash made the query run again writes the same records under other file names
    for part in ("records", "cycles"):
        again = materialize(spark.read.parquet(f"{base}/{part}/batch=replay-0"), "again")
        again.write.mode("overwrite").parquet(f"{base}/{part}/batch=replay-0")
    run(days_per_batch=11)
    assert norm(govern(spark, base)) == got and ST.pipelines(spark, base).first()["records"] == hits


def test_live_stream_equals_batch(spark, log):
    """Windows closed by the watermark, signatures and observations from one aggregate."""
    base, schema = folder("live"), spark.read.parquet(log).schema
    ST.discover_stream(spark, log, schema, base, f"{base}/live", DEFAULT).awaitTermination()
    end = ST.pipelines(spark, base).first()["last_watermark_end"]
    got = norm(govern(spark, base))
    assert got == wanted(spark, log, end) and len(got) > 0


@pytest.mark.parametrize("tolerance", [500, 2500])
def test_live_fusion_near_the_edge_of_a_window(spark, tolerance):
    """An observation in the last or first seconds of a neighbouring window is seen only with a tolerance."""
    opts = DEFAULT.with_(fusion_tolerance_ms=tolerance)
    flows = fx.flows(spark, SF_SMALL)
    row = flows.where("observation_point = 's-p' and endpoint like '/orders/%' and l7_protocol_str = 'HTTP' "
                      "and direction_score = 255").limit(1)
    row = materialize(row, "one").withColumn("pod_service_1", F.lit("")).withColumn("pod_group_1", F.lit(""))
    at = lambda t: F.lit(f"2024-01-02 {t}").cast("timestamp_ntz")
    made = row.withColumn("start_time", at("10:04:59"))
    made = made.unionByName(row.withColumn("start_time", at("10:05:01")).withColumn("observation_point", F.lit("s"))
                            .withColumn("ip4_1", F.lit("10.9.9.9")).withColumn("flow_id", F.lit(-1).cast("long")))
    made = made.unionByName(row.withColumn("start_time", at("11:00:00")).withColumn("flow_id", F.lit(-2).cast("long")))
    base, seen = folder("edge"), []
    made.write.parquet(f"{base}/flows")

    def sink(spark, base, parts, end, name):
        seen.extend(parts["fused"].select("host_ip").collect())
    ST.discover_stream(spark, f"{base}/flows", made.schema, base, f"{base}/w", opts, sink=sink).awaitTermination()
    assert [r["host_ip"] for r in seen] == (["10.9.9.9"] if tolerance > 2000 else [""])


def test_rows_behind_the_watermark_are_dropped(spark):
    """S3: rows that arrive after their window closed are never read again (bounded lateness). S5: the pipeline's end
    moves on although nothing is found."""
    base = folder("late")
    flows = fx.flows(spark, SF_SMALL).withColumn("day", F.to_date("start_time"))
    flows.repartition("day").write.partitionBy("day").parquet(f"{base}/flows")
    schema = spark.read.parquet(f"{base}/flows").schema
    run = lambda: ST.discover_stream(spark, f"{base}/flows", schema, base, f"{base}/live", DEFAULT,
                                     max_files=40).awaitTermination()
    run()
    before = norm(govern(spark, base))
    end = ST.pipelines(spark, base).first()["last_watermark_end"]
    late = (flows.where((F.col("observation_point") == "s-p") & (F.col("day") == F.to_date(F.lit("2024-01-02"))))
            .withColumn("endpoint", F.lit("/late/1")).withColumn("request_resource", F.lit("/late/1"))
            .withColumn("flow_id", F.col("flow_id") + F.lit(10 ** 9)))
    late = materialize(late, "late")
    assert late.count() > 0
    late.write.mode("append").partitionBy("day").parquet(f"{base}/flows")
    run()
    after = norm(govern(spark, base))
    key = D.DISCOVERED_COLS.index("resource_path")
    assert len(before) > 0 and not [r for r in after if r[key].startswith("/late/")]
    # noise alone, a day later: windows close without a signature, and time passes for the state as well
    quiet = late.limit(1).withColumn("endpoint", F.lit("/healthz"))
    for day in ("2024-02-01 00:00:00", "2024-02-01 01:00:00"):
        quiet.withColumn("start_time", F.lit(day).cast("timestamp_ntz")).write.mode("append").partitionBy("day").parquet(f"{base}/flows")
        run()
    assert ST.pipelines(spark, base).first()["last_watermark_end"] > end
    seen = D.DISCOVERED_COLS.index("last_seen_at")
    final = norm(govern(spark, base))
    assert {r[key] for r in after if r[seen] >= "2024-01-03"} <= {r[key] for r in final}
    assert min(r[seen] for r in final) >= "2024-01-01 12"  # what is older than the retention has gone by then


def test_comparison_waits_for_a_fresh_sync(spark):
    """Without a managed sync, and after one that is too old, no verdicts are written; E8: nor without traffic."""
    base = folder("gate")
    ops = spark.createDataFrame([], "reg_api_id string, http_method string, raw_target string, match_path string")
    apis = spark.createDataFrame([], "reg_api_id string, endpoint_hostname string")
    seen = spark.createDataFrame([("s", "GET", "/x", "", "", 80, 1)], "service_key string, http_method string, resource_path string, "
                                 "request_domain string, host_ip string, server_port long, hit_count long")
    run = lambda at, rows=seen: ST.compare_cycle(spark, base, rows, ops, apis, at, DEFAULT)
    ST.log_cycle(spark, base, ST.DISCOVERY, "2024-01-01 00:00:00", 1, "d")
    assert not run("2024-01-01 00:10:00")
    ST.log_cycle(spark, base, ST.MANAGED, "2024-01-01 00:00:00", 1, "m")
    assert not run("2024-01-01 00:30:00") and not run("2024-01-01 00:10:00", seen.limit(0))
    assert run("2024-01-01 00:29:59")
    got = spark.read.parquet(f"{base}/verdicts").collect()
    assert [(r["service_key"], r["unmanaged"], r["classification"], str(r["as_of"])) for r in got] == [
        ("s", True, "SHADOW", "2024-01-01 00:29:59")]


# ------------------------------------------------------------------------------------------- state machine

class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, row):
        self.held = row

    def clear(self):
        self.held = None


class Machine:
    """One key's state machine with a watermark."""

    def __init__(self, opts=DEFAULT):
        self.machine, self.values, self.timers, self.said = S.Governance(opts), {}, set(), []
        self.machine.init(SimpleNamespace(getValueState=lambda n, schema: self.values.setdefault(n, Value()),
                                          registerTimer=self.timers.add, deleteTimer=self.timers.remove))

    def feed(self, *events):
        self.said += [r.change for r in self.machine.handleInputRows(("s", "GET", "/"), iter(events), None)]

    def pass_to(self, at):
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: at // 1000)
        while due := [t for t in self.timers if t * 1000 <= at]:
            self.timers.remove(due[0])
            self.said += [r.change for r in self.machine.handleExpiredTimer(("s", "GET", "/"), clock, None)]

    def finding(self):
        held = self.values["finding"].get()
        return None if held is None else dict(zip(self.machine.finding_names, held, strict=True))

    def row(self):
        held = self.values["discovered"].get()
        return None if held is None else dict(zip(self.machine.row_names, held, strict=True))


class Event(dict):
    __getattr__ = dict.__getitem__


def cycle(at, seen=None, hits=1, **kw):
    blank = dict.fromkeys(S.ROW_COLS)
    seen = at if seen is None else seen
    return Event(blank | {"kind": S.CYCLE, "at": at, "hit_count": hits, "first_seen_at": seen, "last_seen_at": seen} | kw)


def verdict(at, unmanaged=True, cls="SHADOW", api=None):
    return Event(kind=S.VERDICT, at=at, unmanaged=unmanaged, classification=cls, managed_api_id=api, confidence="HIGH")


def test_a_cycle_counts_once_and_late_ones_do_not():
    m = Machine()
    m.feed(cycle(2 * DAY, hits=3, service_ip="a", source_ip="x", request_domain="d"))
    m.feed(cycle(2 * DAY, hits=3, service_ip="a"), cycle(DAY, hits=9))
    m.feed(cycle(3 * DAY, hits=4, service_ip="b", request_domain="e"), cycle(3 * DAY, hits=4))
    row = m.row()
    assert (row["hit_count"], row["service_ip"], row["source_ip"], row["request_domain"]) == (7, "b", "x", "d")
    assert (row["first_seen_at"], row["last_seen_at"], row["created_at"], row["updated_at"]) == (2 * DAY, 3 * DAY, 2 * DAY, 3 * DAY)
    assert m.said == ["DISCOVERED"]


def test_findings_go_stale_and_are_forgotten_by_timers_alone():
    m = Machine()
    m.feed(cycle(DAY), verdict(DAY))
    assert m.timers == {(8 * DAY) // 1000 + 1}
    m.pass_to(8 * DAY)
    assert m.finding()["status"] == "DETECTED"           # seen exactly seven days ago is not older than seven days
    m.pass_to(8 * DAY + 1000)
    assert m.finding()["status"] == "STALE" and m.finding()["resolved_at"] == 8 * DAY + 1000
    m.pass_to(31 * DAY + 1000)
    assert m.row() is None and m.finding() is not None   # purged after 30 days, as no active finding refers to it
    m.pass_to(99 * DAY)
    assert m.finding() is None and not m.timers
    assert m.said == ["DISCOVERED", "DETECTED", "STALE", "PURGED", "FORGOTTEN"]


def test_dismissed_is_terminal_until_the_class_changes():
    m = Machine()
    m.feed(cycle(DAY), verdict(DAY))
    m.feed(Event(kind=S.DISMISS, at=DAY + 5))
    m.feed(verdict(2 * DAY))
    assert m.finding()["status"] == "DISMISSED" and m.finding()["updated_at"] == DAY + 5
    m.feed(verdict(3 * DAY, unmanaged=False))
    assert m.finding()["status"] == "DISMISSED"
    m.feed(verdict(4 * DAY, cls="DRIFT", api="a"), verdict(2 * DAY, unmanaged=False))
    assert m.finding()["status"] == "DETECTED" and m.finding()["first_detected_at"] == DAY
    m.feed(verdict(5 * DAY, unmanaged=False))
    assert m.finding()["status"] == "RESOLVED" and m.finding()["resolved_at"] == 5 * DAY
    m.feed(verdict(6 * DAY, cls="DRIFT", api="a"))
    assert m.finding()["status"] == "DETECTED" and m.finding()["resolved_at"] is None


def test_equals_a_model_that_scans_every_cycle():
    """Random traffic and verdicts: after each cycle the status is what E7, E8 and E9 over all findings give."""
    rng = random.Random(11)
    for _ in range(200):
        m, status, last, held = Machine(), None, None, None
        at = DAY
        for _ in range(30):
            at += rng.choice([DAY // 4, DAY, 3 * DAY, 9 * DAY])
            if last is None or rng.random() < 0.4:
                last = at - rng.choice([0, DAY // 8])
                m.feed(cycle(at, last))
            m.pass_to(at)
            if m.row() is None and m.finding() is None:  # both retentions are over
                status = last = held = None
                continue
            said = (rng.choice(["SHADOW", "DRIFT"]), None) if rng.random() < 0.7 else None
            m.feed(verdict(at, said is not None, *(said or ())))
            if said:
                if status is None or held != said or status in ("RESOLVED", "STALE"):
                    status = "DETECTED"
                held = said
            elif status is not None and status not in S.L.TERMINAL:
                status = "RESOLVED"
            if status == "DETECTED" and m.row() is not None and last < at - 7 * DAY:
                status = "STALE"
            assert (m.finding() or {}).get("status") == status or m.finding() is None and status in S.L.TERMINAL
            if m.finding() is None:
                status = held = None
            if m.row() is None:
                last = None
