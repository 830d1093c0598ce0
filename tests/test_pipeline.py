"""Sequence, invariant and equivalence tests of the operators."""

import tempfile

import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.config import DEFAULT
from flowlens.operators import comparison as C
from flowlens.operators import discovery as D
from flowlens.operators import lifecycle as L
from flowlens.plans import scenarios as S
from flowlens.sources import fixtures as fx

KEY = ["service_key", "http_method", "resource_path"]


def _classified(spark, rows):
    return spark.createDataFrame(rows, "service_key string, http_method string, resource_path string, "
                                       "managed_api_id string, classification string, confidence string")


def _discovered(spark, rows):
    df = spark.createDataFrame(rows, "service_key string, http_method string, resource_path string, "
                                     "last_seen_at string")
    return df.withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp_ntz"))


def test_lifecycle_sequence(spark):
    """DETECTED -> kept -> RESOLVED when not confirmed -> reopened on a classification change; STALE."""
    c1 = _classified(spark, [("s", "GET", "/a", None, "SHADOW", "HIGH"), ("s", "GET", "/b", None, "SHADOW", "HIGH")])
    seen = _discovered(spark, [("s", "GET", "/a", "2024-01-09 00:00:00"), ("s", "GET", "/b", "2024-01-01 00:00:00")])
    u1 = L.comparison_cycle(None, c1, seen, "2024-01-10 00:00:00")
    got = {r["resource_path"]: r["status"] for r in u1.collect()}
    assert got == {"/a": "DETECTED", "/b": "STALE"}            # /b last seen 9 days before
    c2 = _classified(spark, [("s", "GET", "/b", "api-1", "DRIFT", "HIGH")])
    seen2 = _discovered(spark, [("s", "GET", "/a", "2024-01-09 00:00:00"), ("s", "GET", "/b", "2024-01-10 00:00:00")])
    u2 = L.comparison_cycle(u1, c2, seen2, "2024-01-11 00:00:00")
    rows = {r["resource_path"]: r for r in u2.collect()}
    assert rows["/a"]["status"] == "RESOLVED"                 # not confirmed this cycle
    assert rows["/b"]["status"] == "DETECTED" and rows["/b"]["classification"] == "DRIFT"
    assert rows["/b"]["resolved_at"] is None
    assert str(rows["/a"]["first_detected_at"]) == "2024-01-10 00:00:00"


def test_dismissed_is_terminal_until_reopened(spark):
    c = _classified(spark, [("s", "GET", "/a", None, "SHADOW", "HIGH")])
    seen = _discovered(spark, [("s", "GET", "/a", "2024-01-09 00:00:00")])
    u1 = L.comparison_cycle(None, c, seen, "2024-01-10 00:00:00")
    dis = L.dismiss(u1, u1.select(*KEY), "2024-01-10 01:00:00")
    u2 = L.comparison_cycle(dis, c, seen, "2024-01-20 00:00:00")   # same finding: stays DISMISSED
    assert [r["status"] for r in u2.collect()] == ["DISMISSED"]
    c3 = _classified(spark, [("s", "GET", "/a", "api-9", "DRIFT", "HIGH")])
    fresh = _discovered(spark, [("s", "GET", "/a", "2024-01-20 00:00:00")])
    u3 = L.comparison_cycle(u2, c3, fresh, "2024-01-21 00:00:00")  # classification changed: reopened
    assert [r["status"] for r in u3.collect()] == ["DETECTED"]


def test_fusion_first_signature_only(spark):
    """Two services with the same URL, method and second -> only the first (most hits) is enriched."""
    cols = ("flow_id long, observation_point string, start_time string, request_type string, endpoint string, "
            "request_resource string, request_domain string, ip4_0 string, ip4_1 string, is_internet_0 boolean, "
            "pod_service_1 string, pod_ns_1 string, pod_group_1 string, pod_1 string, pod_cluster_1 string, "
            "pod_node_1 string, chost_1 string, process_kname_1 string, process_kname_0 string, pod_0 string, "
            "pod_ns_0 string, pod_service_0 string, pod_cluster_0 string, chost_0 string")
    t = "2024-01-01 00:00:00"
    obs = spark.createDataFrame([(9, "s", t, "GET", "/x", "/x", "", "10.9.9.9", "10.1.1.1", False) + ("",) * 14],
                                cols).withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    sigs = spark.createDataFrame([
        ("GET", "/x", 80, 1, 5, "/x", "/x", 1704067200, "", (-5, "GET", "/x", 80, 1)),
        ("GET", "/x", 81, 2, 3, "/x", "/x", 1704067200, "", (-3, "GET", "/x", 81, 2))],
        "http_method string, resource_path string, server_port long, agent_id long, hit_count long, "
        "sample_path string, sample_url string, sample_second long, request_domain string, "
        "rank struct<neg_hits: long, m: string, e: string, p: long, a: long>")
    out = {r["server_port"]: r["host_ip"] for r in D.fuse(sigs, D.observation_evidence(obs, sigs, DEFAULT), DEFAULT).collect()}
    assert out == {80: "10.1.1.1", 81: ""}
    # a signature without a time takes observations of any second, the first by rank again
    untimed = sigs.withColumn("sample_second", F.lit(None).cast("long")).where("server_port = 80").unionByName(
        sigs.where("server_port = 81").withColumn("rank", F.expr("named_struct('neg_hits', -9L, 'm', rank.m, 'e', rank.e, "
                                                                 "'p', rank.p, 'a', rank.a)")))
    late = obs.withColumn("start_time", F.expr("start_time + INTERVAL 3 hours"))
    for rows, want in ((obs, {80: "", 81: "10.1.1.1"}), (late, {80: "10.1.1.1", 81: ""})):
        known = D.sample_bounds(untimed)
        assert known["untimed"] == 1
        out = D.fuse(untimed, D.observation_evidence(rows, untimed, DEFAULT, known), DEFAULT, untimed=True)
        assert {r["server_port"]: r["host_ip"] for r in out.collect()} == want


def test_hits_conserved_and_partition_of_candidates(spark):
    parts = D.discover_batch(fx.flows(spark, SF_SMALL), DEFAULT)
    kept = parts["kept"].agg(F.sum("hit_count")).first()[0]
    disc = D.batch_records(parts["valid"]).agg(F.sum("hit_count")).first()[0]
    assert kept == disc
    comp = S.comparison(spark, SF_SMALL, DEFAULT)
    cands, cls = comp["candidates"], comp["classified"]
    lost = comp["losers"].select(*KEY)
    managed = cands.where(F.col("reg_api_id").isNotNull()).join(lost, KEY, "left_anti").select(*KEY)
    assert managed.join(cls.select(*KEY), KEY).count() == 0          # never both
    assert managed.count() + cls.count() == cands.count()             # always one of them
    winners = comp["resolved"].groupBy(*C.COLL_KEY).agg(F.count("winner").alias("n"))
    assert winners.where(F.col("n") > 1).count() == 0                 # at most one winner


def test_oracle_subset_small(spark):
    from __spark_entry__ import oracle_sql, queries
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    from tools.check_oracle import digest
    qs, osql = queries(), oracle_sql()
    for name in ("normalized_endpoints", "fused_signatures", "unmanaged_report", "push_plan"):
        ca, ra, _ = digest(qs[name](spark, SF_SMALL).toPandas())
        cb, rb, _ = digest(con.sql(osql[name]).df())
        assert ca == cb and ra == rb, name


def test_push_plan_sink(spark):
    """One JSON record per group, partitioned by action."""
    from flowlens.operators import catalog as CAT
    plan = S.push(spark, SF_SMALL, DEFAULT)["plan"]
    d = tempfile.mkdtemp(prefix="flowlens-push-", dir="/tmp")
    CAT.write_push_plan(plan, f"{d}/plan")
    back = spark.read.json(f"{d}/plan")
    assert back.count() == plan.count()
    assert set(back.columns) >= {"action", "metadata", "definition"}


def test_top_signatures_per_cycle(spark):
    """C2 with cycles: the cap applies inside each cycle, ties broken by the signature key."""
    rows = [("2024-01-01 00:00:00", "GET", "/a", 80, 1, 5), ("2024-01-01 00:00:00", "GET", "/b", 80, 1, 5),
            ("2024-01-01 00:00:00", "GET", "/c", 80, 1, 9), ("2024-01-01 00:05:00", "GET", "/d", 80, 1, 1)]
    df = spark.createDataFrame(rows, "cycle string, http_method string, endpoint string, server_port long, "
                                     "agent_id long, hit_count long")
    got = sorted((r["cycle"], r["endpoint"]) for r in D.top_signatures(df, 2).collect())
    assert got == [("2024-01-01 00:00:00", "/a"), ("2024-01-01 00:00:00", "/c"), ("2024-01-01 00:05:00", "/d")]
