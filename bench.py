"""Benchmark: the five phases on the flow log of $BENCH_SF_DIR (default /root/testdata/sf0.1).

The flow-log fixture is written to parquet once (not part of the metric); every phase then reads
parquet like a deployment does and ends in a written table. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)$", sf_dir)
    sf = float(m.group(1)) if m else None

    from pyspark.sql import functions as F

    from flowlens.config import DEFAULT as opts
    from flowlens.operators import catalog as CAT
    from flowlens.operators import comparison as C
    from flowlens.operators import discovery as D
    from flowlens.operators import lifecycle as L
    from flowlens.operators import managed as M
    from flowlens.operators import specs as SP
    from flowlens.session import build_session, materialize
    from flowlens.sources import registry as A
    from flowlens.sources import fixtures as fx

    scratch = tempfile.mkdtemp(prefix="flowlens-bench-", dir=os.environ.get("FLOWLENS_SCRATCH", "/tmp"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          extra={"spark.checkpoint.dir": f"{scratch}/checkpoint"})
    spark.sparkContext.setCheckpointDir(f"{scratch}/checkpoint")
    times, rows = {}, {}

    def timed(name, fn):
        t0 = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t0, 3)
        return out

    # input: the flow log as parquet (setup, not measured in the total)
    flow_path = f"{scratch}/flows"
    timed("setup_flow_parquet", lambda: fx.flows(spark, sf_dir).write.parquet(flow_path))
    flows = spark.read.parquet(flow_path)
    rows["flow_rows"] = flows.count()

    as_of = fx.AS_OF
    discovered = timed("discovery", lambda: materialize(D.discovered_from_flows(flows, opts, as_of), "discovered"))
    rows["discovered"] = discovered.count()

    def managed():
        pub = A.published(A.parse_details(A.details_json_from_flat(fx.managed_src(spark, sf_dir))),
                          opts.include_api_types)
        apis, ops = M.managed_from_json(pub, opts.context_pass_through)
        api_state, op_state, _ = M.merge_managed(None, None, M.classify_sync(apis, None), ops, as_of)
        return materialize(api_state, "managed_apis"), materialize(op_state, "managed_ops")
    api_state, op_state = timed("managed_sync", managed)

    def comparison():
        parts = C.compare(discovered, M.active_ops(op_state, api_state),
                          api_state.where(F.col("deleted_at").isNull()))
        return materialize(L.comparison_cycle(None, parts["classified"], discovered, as_of, opts.stale_after),
                           "unmanaged")
    unmanaged = timed("comparison", comparison)
    rows["unmanaged"] = unmanaged.count()

    def specs():
        out = SP.generate_specs(unmanaged, discovered, api_state, opts, as_of)
        docs = materialize(out["documents"], "documents")
        return docs, materialize(L.apply_specs(unmanaged, docs, as_of), "unmanaged_specs")
    docs, with_specs = timed("spec_documents", specs)
    rows["documents"] = docs.count()

    def catalog():
        plan = materialize(CAT.push_plan(L.push_groups(with_specs, docs), fx.catalog_src(spark, sf_dir), opts, as_of),
                           "push_plan")
        pushed = materialize(L.apply_push_results(with_specs, CAT.push_results(plan), as_of), "pushed")
        rec = materialize(CAT.reconcile(fx.catalog_src(spark, sf_dir), L.tracked_ids(pushed), opts), "reconcile")
        return plan, rec
    plan, rec = timed("catalog_push_reconcile", catalog)
    rows["push_plan"] = plan.count()

    # replay of the flow log split by day, and its state; reported apart from the total
    from flowlens.streaming import stream as ST
    day_path = f"{scratch}/flows_by_day"
    timed("setup_day_files", lambda: flows.withColumn("day", F.to_date("start_time")).repartition("day")
          .write.partitionBy("day").parquet(day_path))

    def replay():
        ST.replay(spark, day_path, f"{scratch}/stream", f"{scratch}/stream/replay", opts)
        ST.govern(spark, f"{scratch}/stream", f"{scratch}/stream/govern", opts).awaitTermination()
    timed("stream_replay", replay)
    stream_secs = times.pop("stream_replay")

    measured = [k for k in times if not k.startswith("setup")]
    total = round(sum(times[k] for k in measured), 3)
    print(json.dumps({"metric": "pipeline_total_sec", "value": total, "unit": "sec",
                      "queries": {k: times[k] for k in measured}, "setup": {k: times[k] for k in times if k.startswith("setup")},
                      "rows": rows, "sf": sf, "cpus": cpus,
                      "flow_rows_per_sec_discovery": round(rows["flow_rows"] / max(times["discovery"], 1e-9), 1),
                      "stream_replay_sec": round(stream_secs, 3),
                      "stream_replay_rows_per_sec": round(rows["flow_rows"] / max(stream_secs, 1e-9), 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
