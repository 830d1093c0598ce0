"""Incremental discovery and governance (S1-S6) on Structured Streaming.

The reference polls the flow store every 5 minutes for [last end, now - 2 min). Here three queries share a folder:

* ``discover_stream`` reads the flow log as it grows. One stateful aggregate over 5-minute event-time windows with a 2-minute
  watermark (bounded lateness: a row that arrives after its window closed is dropped, as the reference never reads a window
  twice) holds the signatures and, by (url, method, second), the observations of each window. A micro-batch carries
  both for the windows that closed, so a cycle's fusion (J1) reads the log no second time.
* ``replay`` does the same for a log that is already there, in one query whose source hands out the log's days in event
  order, so no row is late whatever the order and number of the files. Cycles never cross a day.
* ``govern`` keeps the state: records of cycles and verdicts of comparisons go to one stateful operator (``state``).

A cycle's records are written under a name made of stream and batch, and a repeated batch overwrites them; the state takes
each cycle once, so a crash anywhere loses and doubles nothing.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..config import Options
from ..operators import comparison as C
from ..operators import discovery as D
from ..session import discard, materialize
from . import state as ST

DISCOVERY = "api_discovery"
MANAGED = "managed_api_sync"
EPOCH = datetime(1970, 1, 1)
RECORDS = ", ".join(f"{c} {'timestamp_ntz' if c in ST.TIMES else ST.TYPES.get(c, 'string')}" for c in D.DISCOVERED_COLS) \
    + ", cycle_end timestamp_ntz, batch string"
VERDICTS = ", ".join(f"{k} string" for k in D.DISCOVERED_KEY) + ", kind int, as_of timestamp_ntz, unmanaged boolean, " \
    + ", ".join(f"{c} string" for c in ST.VERDICT_COLS) + ", batch string"
#: Rows of a log's file, bytes of files that a task of the stream reads, and bytes of the log for each partition of its state.
FILE_ROWS, READ_BYTES, STATE_BYTES = 200_000, 16 << 20, 8 << 20
CYCLES = "pipeline string, cycle_end timestamp_ntz, n long"


# --------------------------------------------------------------------------------- pipelines

def advance_watermark(state: DataFrame | None, upd: DataFrame) -> DataFrame:
    """E6 as a join: (pipeline, end, n) rows set the end and add n to the running count."""
    if state is None:
        return upd.select("pipeline", F.col("end").alias("last_watermark_end"), F.col("n").alias("records"))
    j = state.join(upd, "pipeline", "full_outer")
    return j.select("pipeline",
                    F.coalesce(F.col("end"), F.col("last_watermark_end")).alias("last_watermark_end"),
                    (F.coalesce(F.col("records"), F.lit(0)) + F.coalesce(F.col("n"), F.lit(0))).alias("records"))


def log_cycle(spark: SparkSession, base: str, pipeline: str, end, n: int | DataFrame, name: str) -> None:
    """E6 (+S5): one row a cycle, empty ones too; a repeated cycle writes the same row again."""
    if isinstance(n, int):
        n = spark.range(1).select(F.lit(n).alias("n"))
    row = n.select(F.lit(pipeline).alias("pipeline"), F.lit(str(end)).cast("timestamp_ntz").alias("cycle_end"),
                   F.col(n.columns[0]).cast("long").alias("n"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{base}/cycles/batch={name}")


def pipelines(spark: SparkSession, base: str) -> DataFrame:
    """End of the last cycle and running count of each pipeline (hits for discovery, APIs for managed)."""
    return spark.read.schema(CYCLES).parquet(f"{base}/cycles").groupBy("pipeline").agg(
        F.max("cycle_end").alias("last_watermark_end"), F.sum("n").alias("records"))


def next_window(state: DataFrame, pipelines: DataFrame, as_of, opts: Options) -> DataFrame:
    """Per pipeline, start = last watermark end or as_of - (poll + lag) on a first run;
    end = as_of - lag; runnable only when end > start. Times are whole seconds."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    end = now - F.expr(f"INTERVAL {opts.safety_lag}")
    first = now - F.expr(f"INTERVAL {opts.poll_interval}") - F.expr(f"INTERVAL {opts.safety_lag}")
    j = pipelines.select("pipeline").join(state, "pipeline", "left")
    start = F.coalesce(F.col("last_watermark_end"), first)
    return j.select("pipeline", F.date_trunc("second", start).alias("window_start"),
                    F.date_trunc("second", end).alias("window_end"), (end > start).alias("runnable"))


def is_fresh(state: DataFrame, as_of, opts: Options, pipeline: str = MANAGED) -> DataFrame:
    """Comparison may run only if the last managed sync is younger than factor x its interval."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    limit = now - F.expr(f"INTERVAL {opts.managed_sync_interval}") * opts.managed_fresh_factor
    s = state.where(F.col("pipeline") == pipeline)
    return s.select("pipeline", (F.col("last_watermark_end") > limit).alias("fresh"))


# --------------------------------------------------------------------------------- cycles

def window_stream(flows: DataFrame, opts: Options) -> DataFrame:
    """S2 + S3: signatures and observation evidence of each tumbling window, closed by the event-time watermark."""
    rows = D.roles(flows, opts).withWatermark("role_time", opts.safety_lag)
    traffic = F.col("kind") == "signature"
    return rows.groupBy(F.window("role_time", opts.poll_interval).alias("win"), "kind", "http_method", "path", "key_port",
                        "key_agent", "sec").agg(*D.signature_aggregates(traffic), *D.evidence_aggregates(~traffic))


def closed_parts(closed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signatures, evidence) of closed windows, each with its cycle."""
    closed = closed.select(*D.cycle_columns(), *[c for c in closed.columns if c != "win"])
    sigs = closed.where("kind = 'signature'").withColumnsRenamed(
        {"path": "endpoint", "key_port": "server_port", "key_agent": "agent_id"})
    evidence = closed.where("kind = 'observation'").select(
        "cycle", F.col("path").alias("url"), F.col("http_method").alias("method"), "sec", *D.evidence_names())
    return D.signature_rows(sigs, "cycle", "cycle_end"), evidence


def _step(opts: Options) -> int:
    return ST.micros(opts.poll_interval) // 1_000_000


def closed_before(time: datetime, opts: Options) -> datetime:
    """End of the last window that a watermark has closed."""
    return EPOCH + timedelta(seconds=int((time - EPOCH).total_seconds()) // _step(opts) * _step(opts))


def _closed_by(query, opts: Options) -> datetime | None:
    """End of the windows that the running batch of a query has closed: its watermark follows from what the batch before
    it saw. None before the first."""
    seen = ((query.lastProgress if query is not None else None) or {}).get("eventTime") or {}
    times = [datetime.strptime(seen[k][:19], "%Y-%m-%dT%H:%M:%S") for k in ("watermark", "max") if seen.get(k)]
    if not times:
        return None
    mark = max(times[0], times[-1] - timedelta(microseconds=ST.micros(opts.safety_lag)))
    return None if mark <= EPOCH + timedelta(days=1) else closed_before(mark, opts)


def write_cycle(spark: SparkSession, base: str, parts: dict[str, DataFrame], end, name: str) -> None:
    """The records of a batch of cycles, and its row in the pipeline log. Both are named, so a repeat replaces them."""
    at = F.lit(str(end)).cast("timestamp_ntz").alias("cycle_end")
    columns = [F.col(c) if c in ST.TIMES else F.col(c).cast(ST.TYPES.get(c, "string")).alias(c) for c in D.DISCOVERED_COLS]
    D.batch_records(parts["valid"]).select(*columns, at).write.mode("overwrite").parquet(f"{base}/records/batch={name}")
    log_cycle(spark, base, DISCOVERY, end, D.total_hits(parts["deduped"]), name)
    discard(parts["deduped"])


def _name(checkpoint: str, batch_id: int) -> str:
    """Streams are told apart by their checkpoints' last folder."""
    return f"{re.sub('[^A-Za-z0-9]+', '', checkpoint.rstrip('/').rsplit('/', 1)[-1])}-{batch_id}"


@contextmanager
def bounded_tasks(spark: SparkSession, flow_path: str):
    """Settings under which a stream over a log starts, so that what one task sorts and holds has a bound whatever the log:
    its tasks read few bytes, its state has a partition for so many bytes of the log and lies on disk. A query keeps the
    settings it starts with, and a checkpoint the partitions and the store of its first start; only the bytes of a task are
    looked up in the session at each batch, so that setting stays."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(flow_path)
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    store = "spark.sql.streaming.stateStore"
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(READ_BYTES))
    conf = {f"{store}.providerClass": ST.ROCKSDB, f"{store}.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // STATE_BYTES))}
    held = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discover_stream(spark: SparkSession, flow_path: str, flow_schema, base: str, checkpoint: str, opts: Options,
                    trigger: dict | None = None, max_files: int | None = None, start=None, sink=write_cycle):
    """Start the incremental discovery on files that arrive in event order; ``trigger`` defaults to availableNow, in
    production it is ``{"processingTime": opts.poll_interval}``. ``start`` skips what a replay has done; ``sink`` takes the
    parts of a batch of cycles. Returns the StreamingQuery."""
    reader = spark.readStream.schema(flow_schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    flows = D.time_window(reader.parquet(flow_path), start)
    started: dict = {}

    def cycle(closed: DataFrame, batch_id: int) -> None:
        closed = materialize(closed, "closed_windows")
        sigs, evidence = closed_parts(closed)
        ends = [sigs.agg(F.max("cycle_end")).first()[0], _closed_by(started.get("query"), opts)]
        end = max((e for e in ends if e is not None), default=None)  # S5: time passes also where nothing is found
        if ends[0] is not None:
            sink(spark, base, D.after_signatures(sigs, evidence, opts), end, _name(checkpoint, batch_id))
        elif end is not None:
            log_cycle(spark, base, DISCOVERY, end, 0, _name(checkpoint, batch_id))
        discard(closed)

    with bounded_tasks(spark, flow_path):
        query = (window_stream(flows, opts).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                 .foreachBatch(cycle).trigger(**(trigger or {"availableNow": True})).start())
    started["query"] = query
    return query


class FlowDays(DataSource):
    """Streaming source of a log's days in event order, ``per_batch`` of them a micro-batch; its offset is the last day."""

    @classmethod
    def name(cls) -> str:
        return "flow_days"

    def schema(self) -> str:
        return "day string"

    def simpleStreamReader(self, schema):
        return _Days(self.options["days"].split(","), int(self.options["per_batch"]))


class _Days(SimpleDataSourceStreamReader):
    def __init__(self, days: list[str], per_batch: int):
        self.days, self.per_batch = sorted(days), per_batch

    def initialOffset(self) -> dict:
        return {"after": ""}

    def read(self, start: dict):
        found = [d for d in self.days if d > start["after"]][:self.per_batch]
        return iter([(d,) for d in found]), {"after": found[-1] if found else start["after"]}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(d,) for d in self.days if start["after"] < d <= end["after"]])


def replay(spark: SparkSession, flow_path: str, base: str, checkpoint: str, opts: Options, days_per_batch: int = 10,
           until=None) -> datetime | None:
    """Backfill of a flow log in day folders, whatever the order and number of files, in one query; it can be stopped and
    started again. Returns the end of the closed windows: those before ``until``, by default the newest traffic less the
    safety lag. What comes after is left to ``discover_stream``, or to a later replay where it is a whole number of days."""
    log = spark.read.parquet(flow_path)
    if until is None:
        newest = D.traffic_filter(log, opts).agg(F.max("start_time")).first()[0]
        until = None if newest is None else newest - timedelta(microseconds=ST.micros(opts.safety_lag))
    if until is None:
        return None
    end = closed_before(until, opts)
    days = [str(r["day"]) for r in log.where(F.col("day").cast("timestamp_ntz") < F.lit(str(end)).cast("timestamp_ntz"))
            .select("day").distinct().collect()]  # one row a day of the log
    if not days:
        return end
    spark.dataSource.register(FlowDays)

    def cycle(batch: DataFrame, batch_id: int) -> None:
        chosen = sorted(r["day"] for r in batch.collect())
        last = min(end, datetime.fromisoformat(chosen[-1]) + timedelta(days=1))
        flows = D.read_flows(spark, flow_path, f"{chosen[0]} 00:00:00", last)
        parts = D.discover_batch(flows, opts, cycle=opts.poll_interval)
        write_cycle(spark, base, parts, last, _name(checkpoint, batch_id))

    calendar = (spark.readStream.format("flow_days").option("days", ",".join(sorted(days)))
                .option("per_batch", days_per_batch).load())
    query = (calendar.writeStream.option("checkpointLocation", checkpoint).foreachBatch(cycle)
             .trigger(processingTime="0 seconds").start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return end


def replay_batch(flows: DataFrame, opts: Options, until=None) -> DataFrame:
    """Batch twin of the stream: the same tumbling cycles over the whole log, merged at once.

    ``until`` keeps only cycles that end at or before it (the ones a stream has closed).
    """
    return D.batch_records(D.discover_batch(flows, opts, end=until, cycle=opts.poll_interval)["valid"])


# --------------------------------------------------------------------------------- state

def govern(spark: SparkSession, base: str, checkpoint: str, opts: Options, trigger: dict | None = None):
    """Start the query that keeps the state; the change feed goes to ``changes``. Returns the StreamingQuery."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.ROCKSDB)
    for name, schema in (("records", RECORDS), ("verdicts", VERDICTS), ("cycles", CYCLES)):  # a source folder has to exist
        columns = schema.removesuffix(", batch string")
        spark.createDataFrame([], columns).write.mode("ignore").parquet(f"{base}/{name}/batch=none")
    read = spark.readStream.option("ignoreMissingFiles", "true")  # a repeated batch replaces its files
    events = ST.record_events(read.schema(RECORDS).parquet(f"{base}/records")).unionByName(
        ST.verdict_events(read.schema(VERDICTS).parquet(f"{base}/verdicts"))).unionByName(
        ST.clock_events(read.schema(f"{CYCLES}, batch string").parquet(f"{base}/cycles").where(F.col("pipeline") == DISCOVERY)))
    return (ST.governed(events, opts).writeStream.format("parquet").option("path", f"{base}/changes")
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start())


def write_verdicts(spark: SparkSession, base: str, rows: DataFrame, as_of) -> None:
    """(key, kind, unmanaged, ...) rows as the verdicts of a time."""
    name = re.sub("[^0-9]", "", str(as_of))
    rows.select(*D.DISCOVERED_KEY, "kind", F.lit(str(as_of)).cast("timestamp_ntz").alias("as_of"), "unmanaged",
                *ST.VERDICT_COLS).write.mode("overwrite").parquet(f"{base}/verdicts/batch={name}")


def compare_cycle(spark: SparkSession, base: str, discovered: DataFrame, ops: DataFrame, apis: DataFrame, as_of,
                  opts: Options) -> bool:
    """One comparison cycle of the discovered state against the active registered side, as verdicts for ``govern``. S6: it
    is skipped, and False returned, while the last managed sync is too old, and when nothing is discovered (E8)."""
    fresh = is_fresh(pipelines(spark, base), as_of, opts).first()
    if fresh is None or not fresh["fresh"]:
        return False
    parts = C.compare(discovered, ops, apis)
    if parts["candidates"].isEmpty():
        return False
    said = parts["classified"].select(*D.DISCOVERED_KEY, *ST.VERDICT_COLS, F.lit(True).alias("unmanaged"))
    rows = parts["candidates"].select(*D.DISCOVERED_KEY).join(said, D.DISCOVERED_KEY, "left")
    write_verdicts(spark, base, rows.withColumn("unmanaged", F.coalesce("unmanaged", F.lit(False)))
                   .withColumn("kind", F.lit(ST.VERDICT)), as_of)
    return True
