"""Comparison of changes against the whole comparison, over cycles of random traffic and registrations."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import comparison as C
from flowlens.operators import incremental as I
from flowlens.session import materialize

DISCOVERED = ("service_key string, http_method string, resource_path string, request_domain string, host_ip string, "
              "server_port long, hit_count long")
OPS = "reg_api_id string, http_method string, raw_target string, match_path string"
APIS = "reg_api_id string, endpoint_hostname string"


def rows_of(df, columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("seed", range(4))
def test_equals_whole_comparison(spark, seed):
    rng = random.Random(seed)
    paths = [("GET", f"/p{i}") for i in range(8)] + [("POST", f"/p{i}") for i in range(3)]
    services, names = [f"s{i}" for i in range(6)], [f"a{i}" for i in range(5)]
    traffic, registered, hosts = {}, {}, {}

    def visit(n):
        for _ in range(n):
            s, (m, p) = rng.choice(services), rng.choice(paths)
            old = traffic.get((s, m, p))
            domain = old[0] if old else rng.choice(["", f"{s}.example.com:80", f"h{rng.randint(0, 2)}.example.com"])
            traffic[s, m, p] = (domain, rng.choice(["", "10.0.0.1"]), 80, (old[3] if old else 0) + 1)
            yield s, m, p

    def register(n):
        for a in rng.sample(names, n):
            hosts[a] = rng.choice(["", "h0.example.com", "h1.example.com", "s1.example.com"])
            registered[a] = [(m, f"{p}#{k}", p) for k, (m, p) in enumerate(rng.choices(paths, k=rng.randint(0, 5)))]

    def tables():
        ops = spark.createDataFrame([(a, m, raw, p) for a, held in registered.items() for m, raw, p in held], OPS)
        return ops, spark.createDataFrame(list(hosts.items()), APIS)

    def frame(keys):
        return spark.createDataFrame([(*k, *traffic[k]) for k in sorted(keys)], DISCOVERED)

    list(visit(25))
    register(5)
    ops, apis = tables()
    before = C.compare(frame(traffic), ops, apis)
    before = {k: materialize(before[k], k) for k in ("candidates", "resolved", "classified")}
    for step in range(3):
        fresh = set(visit(rng.randint(0, 5)))
        if step != 1:
            register(rng.randint(0, 2))
        lost = [k for k in rng.sample(sorted(traffic), 2) if k not in fresh] if step == 2 else []
        for k in lost:
            del traffic[k]
        ops_before, apis_before = ops, apis
        ops, apis = tables()
        gone = spark.createDataFrame(lost, ", ".join(DISCOVERED.split(", ")[:3]))
        before = I.compare_changes(before, frame(fresh), ops_before, ops, apis_before, apis, gone)
        want = C.compare(frame(traffic), ops, apis)
        for name in ("candidates", "resolved", "classified"):
            columns = want[name].columns
            assert rows_of(before[name], columns) == rows_of(want[name], columns), (step, name)
        assert before["touched"].join(before["candidates"], I.KEY, "left_anti").count() == 0


def test_nothing_changed_touches_nothing(spark):
    ops = spark.createDataFrame([("a", "GET", "/x", "/x")], OPS)
    apis = spark.createDataFrame([("a", "h")], APIS)
    rows = spark.createDataFrame([("s", "GET", "/x", "", "", 80, 1), ("t", "GET", "/x", "", "", 80, 1), ("t", "GET", "/y", "", "", 80, 1)],
                                 DISCOVERED)
    before = C.compare(rows, ops, apis)
    after = I.compare_changes(before, rows.limit(0), ops, ops, apis, apis)
    assert after["touched"].count() == 0
    assert rows_of(after["classified"], after["classified"].columns) == rows_of(before["classified"], after["classified"].columns)
    moved = I.compare_changes(before, rows.limit(0), ops, ops.withColumn("match_path", F.lit("/y")), apis, apis)
    want = C.compare(rows, ops.withColumn("match_path", F.lit("/y")), apis)["classified"]
    assert rows_of(moved["classified"], want.columns) == rows_of(want, want.columns)
