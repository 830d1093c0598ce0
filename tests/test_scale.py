"""What a task reads, sorts and tries has a bound, with the same rows."""

import tempfile
from datetime import datetime, timedelta

from conftest import SF_SMALL
from pyspark.sql import functions as F

from flowlens.config import API_TIME_FORMATS
from flowlens.functions import text as T
from flowlens.operators import discovery as D
from flowlens.operators import managed as M
from flowlens.plans import queries as Q
from flowlens.sources import fixtures as fx
from flowlens.streaming import stream as ST


def folder(spark, rows):
    d = tempfile.mkdtemp(prefix="flowlens-scale-", dir="/tmp")
    event = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    at = datetime(2024, 1, 1)
    events = [(i, at + timedelta(minutes=i), i % 40, "view", 1.0, '{"k": %d}' % (i % 90)) for i in range(rows)]
    spark.createDataFrame(events, event).coalesce(1).write.parquet(f"{d}/events.parquet")
    spark.range(rows).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_tables_of_one_file_are_read_by_all_cores(spark):
    d = folder(spark, 500)
    rows = fx.wide_details_json(spark, d)
    assert len(rows.inputFiles()) >= spark.sparkContext.defaultParallelism
    assert len(fx.flows(spark, d).inputFiles()) >= spark.sparkContext.defaultParallelism
    ids = rows.select(F.get_json_object("json", "$.id").alias("id"))
    assert ids.count() == 500 and ids.distinct().count() == 500
    spark.range(7).select(F.col("id").alias("p_partkey")).coalesce(1).write.mode("overwrite").parquet(f"{d}/part.parquet")
    assert fx.wide_details_json(spark, d).count() == 7


def test_times_are_tried_with_the_formats_of_their_shape_alone(spark):
    texts = ["2024-01-05T10:30:00.250+0530", "2024-01-05T10:30:00.250Z", "2024-01-05t10:30:00.250z", "2024-01-05T10:30:00-0200",
             "2024-01-05T10:30:00.5+01:00", "2024-01-05T10:30:00+01:00", "2024-01-05T10:30:00Z", "2024-01-05T10:30:00.123456789Z",
             "2024-01-05T10:30:00.5+0100", "2024-01-05 10:30:00", "2024-01-05 10:30:00.5", "2024-01-05T10:30:00", "yesterday", "",
             "+12024-01-05 10:30:00", "2024-01-05T10:30:00.250", "2024-01-05T10:30:00 +0100", "2024-13-05T10:30:00Z", None,
             "2024-01-05 10:30:00\n", "2024-01-05T10:30:00.1234567890Z", "2024-01-05T10:30:00+05", "2024-1-5T10:30:00Z"]
    plain = F.coalesce(*[F.try_to_timestamp(T.nz("t"), F.lit(f)) for f in API_TIME_FORMATS]).cast("timestamp_ntz")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", T.parse_api_time("t").cast("string").alias("a"), plain.cast("string").alias("b"))
    got = rows.collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and sum(r["a"] is not None for r in got) > 8
    import re
    tried = [f for f in API_TIME_FORMATS if re.search(T.api_time_shape(f).replace(r"\z", r"\Z"), "yesterday")]
    assert tried == []


def test_a_stream_has_more_and_no_larger_tasks_for_a_larger_log(spark, monkeypatch):
    monkeypatch.setattr(ST, "FILE_ROWS", 100)
    monkeypatch.setattr(ST, "STATE_BYTES", 1 << 12)
    base = Q._stream_folder(spark, folder(spark, 4000))
    log = spark.read.parquet(f"{base}/flows")
    assert log.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 100
    assert log.select("flow_id").distinct().count() == log.count() == fx.flows(spark, folder(spark, 4000)).count()
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    with ST.bounded_tasks(spark, f"{base}/flows"):
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > int(before["spark.sql.shuffle.partitions"])
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(ST.READ_BYTES)  # batches look it up as they run
    assert before == {k: spark.conf.get(k, None) for k in before}


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_of_the_flow_log_are_on_written_columns(spark):
    d = folder(spark, 400)
    flows = fx.flows(spark, d)
    assert "regexp_extract" not in plan_of(D.traffic_filter(flows, Q.OPTS, end="2024-01-01 03:00:00"))
    rows = {(r["event_id"], p) for r in spark.read.parquet(f"{d}/events.parquet").collect()
            for p in ("s-p", *(["s"] if r["event_id"] % 4 else []), *([] if r["event_id"] % 3 else ["c-p"]))}
    got = flows.select(F.floor(F.col("flow_id") / 3), "observation_point").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == rows


def test_documents_and_urls_are_read_once_for_each_row(spark):
    plan = plan_of(M.with_endpoints(Q._wide_published(spark, folder(spark, 300))))
    assert plan.count("from_json(") == 1 and "to_json" not in plan
    assert plan.count("get_json_object(") <= 8  # with the copies that Spark prints of a lambda's body
    texts = ["http://u@h:81/a%20b/", "http://[::1]/x", "http://h:bad/", "mailto:x", "//h/%zz", "/p/", "", None, "HTTPS://H?q"]
    urls = spark.createDataFrame([(t,) for t in texts], "t string")
    assert plan_of(urls.select(T.parse_endpoint("t").alias("u")).select("u.*")).count("try_url_decode") <= 1
    want = [("h", 81, "/a b"), ("::1", 80, "/x"), ("", 0, ""), ("", 80, ""), ("", 0, ""), ("", 80, "/p"), ("", 0, ""), ("", 0, ""),
            ("H", 443, "")]
    assert [tuple(r[0]) for r in urls.select(T.parse_endpoint("t")).collect()] == want


def test_a_sync_reads_documents_once(spark):
    apis, ops, _ = Q._wide_synced(spark, folder(spark, 300))
    for state in (apis, ops):
        assert all("/flowlens-tables/wide_" in f for f in state.inputFiles())
