"""Spark session settings the engine relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Observation, SparkSession

# Settings every job of the engine expects. AQE re-plans joins from runtime sizes (a side becomes a
# broadcast only when its measured shuffle output is under the threshold) and splits skewed
# partitions; the session time zone is fixed so epoch-second arithmetic is stable.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", app: str = "flowlens", shuffle_partitions: int = 8,
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own builder plus ENGINE_CONF."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(ENGINE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_engine_conf(spark: SparkSession) -> None:
    """Set those ENGINE_CONF entries that can change at run time and that the caller left unset."""
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for k, v in ENGINE_CONF.items():
        if k not in given and spark.conf.isModifiable(k):
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for written tables: the one the cluster names in ``spark.checkpoint.dir``.

    A session that names none gets a scratch folder only with a ``local`` master, where driver and
    tasks are one process. On any other master executors could not see it, so this raises.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="flowlens-ckpt-", dir=os.environ.get("FLOWLENS_SCRATCH", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def materialize(df, name: str = "table"):
    """Cut lineage at a phase boundary: write the rows as a parquet table in the shared checkpoint
    folder and read them back.

    Used where a result is a state table of the reference (discovered, managed) or is read by many
    later steps (comparison candidates). The table lives in the folder the cluster names in
    ``spark.checkpoint.dir`` (see ``ensure_checkpoint_dir``), so it survives executor
    loss; later reads get column pruning and filter pushdown. (A Dataset ``checkpoint()`` of the
    same plan was measured 60x slower here: it recomputes the plan for the RDD write.)
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/flowlens-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


_WRITTEN: dict = {}


def written_once(spark, path: str, name: str, make):
    """The table that ``make`` gives of the parquet table at ``path``, written once a session and state of its files. The rows
    are dealt out to tasks evenly before: a file is split by its row groups of up to a million rows, so few files leave cores
    without work. What Spark pushes to the scan of the written table runs on all cores as well, and on its columns as they
    are: expressions that made them are not put into the filter again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    key = (name, spark.sparkContext.applicationId,
           tuple(sorted(map(tuple, files.select("path", "length", "modificationTime").collect()))))
    if key not in _WRITTEN:
        table, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
        if len(table.inputFiles()) < cores:
            table = table.repartition(max(3 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        _WRITTEN[key] = materialize(make(table), name)
    return _WRITTEN[key]


def observed(df, name: str, counters: dict, into: dict):
    """``materialize`` that adds to ``into`` the values of aggregate columns over the rows, taken while they are written;
    no second scan. Without rows they are 0."""
    seen = Observation()
    table = materialize(df.observe(seen, *[c.alias(k) for k, c in counters.items()]), name)
    got = seen.get
    into.update({k: got.get(k) or 0 for k in counters})
    return table


def discard(table) -> None:
    """Delete the folder of a table made by ``materialize`` that no later step reads."""
    spark = table.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if "/flowlens-tables/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
