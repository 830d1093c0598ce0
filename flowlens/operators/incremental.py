"""Comparison of what changed (C5-C10 between cycles): only what a cycle's new rows or a changed registered API can
reach is matched, scored, resolved and classified again; the rest of the last result is carried over.

What an outcome depends on, and so what is done again:

* a match: its (method, path). Again for rows that are new or touched, and where the index of operations changed;
* a resolution of (method, path, API): its members, their scores for the API and their domains, and the API's host. Again at
  those paths, for every collision of an API that is matched there or has changed itself, and for every collision that has
  a member among the services of those rows;
* a finding: all rows of its service and the resolutions at their paths. Again for every service with a row at a path where
  something was resolved again.

Each of these sets is a join of the last one with the candidates, so its size follows the change and not the tables. The
carried-over rows are read and written, but neither shuffled nor scored; ``left_anti`` joins with a small set become
broadcasts once its written size is known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import materialize
from . import comparison as C

KEY = ["service_key", "http_method", "resource_path"]
PATH = ["http_method", "resource_path"]


def _differs(before: DataFrame, now: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys whose value differs, or that only one side has."""
    j = before.withColumnRenamed(value, "_old").join(now.withColumnRenamed(value, "_new"), key, "full_outer")
    return j.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*key)


def changed_apis(ops_before: DataFrame, ops: DataFrame, apis_before: DataFrame, apis: DataFrame) -> DataFrame:
    """APIs whose operations (with their number on one match path) or whose endpoint host changed."""
    held = lambda o: o.groupBy("reg_api_id", "http_method", "match_path").agg(F.count("*").alias("n"))
    host = lambda a: a.select("reg_api_id", T.nz(F.col("endpoint_hostname")).alias("host"))
    moved = _differs(held(ops_before), held(ops), ["reg_api_id", "http_method", "match_path"], "n").select("reg_api_id")
    return moved.union(_differs(host(apis_before), host(apis), ["reg_api_id"], "host")).distinct()


def compare_changes(before: dict[str, DataFrame], fresh: DataFrame, ops_before: DataFrame, ops: DataFrame,
                    apis_before: DataFrame, apis: DataFrame, gone: DataFrame | None = None) -> dict[str, DataFrame]:
    """The result of ``comparison.compare`` after a change, from the one before it (candidates, resolved, classified).

    ``fresh`` holds the discovered rows that are new or were touched since, ``gone`` the keys that were purged. Adds
    ``touched``, the keys whose verdict may have changed.
    """
    old = before["candidates"]
    removed = fresh.select(*KEY) if gone is None else fresh.select(*KEY).union(gone.select(*KEY))
    removed = materialize(removed.distinct(), "removed_keys")
    index = materialize(C.op_index(ops), "op_index")
    moved = materialize(_differs(C.op_index(ops_before), index, PATH, "reg_api_id"), "moved_paths")
    paths = materialize(moved.union(removed.select(*PATH)).distinct(), "changed_paths")

    # 1. candidates
    stay = old.join(removed, KEY, "left_anti")
    again = stay.join(moved, PATH, "left_semi").drop("reg_api_id").unionByName(C.match(fresh, ops, index).drop("reg_api_id"))
    again = materialize(again.join(index, PATH, "left").select(*C.CAND_COLS), "rematched")
    cands = materialize(stay.join(moved, PATH, "left_anti").select(*C.CAND_COLS).unionByName(again), "candidates")

    # 2. resolutions
    services = again.select("service_key").union(removed.select("service_key")).distinct()
    matched = cands.where(F.col("reg_api_id").isNotNull())
    of_path = [x.join(paths, PATH, "left_semi").select("reg_api_id").where("reg_api_id is not null") for x in (old, cands)]
    of_change = changed_apis(ops_before, ops, apis_before, apis)
    reached = reduce(DataFrame.union, [*of_path, of_change]).distinct()
    opened = [matched.join(paths, PATH, "left_semi"), matched.join(reached, "reg_api_id", "left_semi"),
              matched.join(services, "service_key", "left_semi")]
    opened = materialize(reduce(DataFrame.union, [o.select(*C.COLL_KEY) for o in opened]).distinct(), "opened_collisions")
    members = cands.join(opened, C.COLL_KEY, "left_semi")
    near = materialize(cands.join(members.select("service_key").distinct(), "service_key", "left_semi"), "members_candidates")
    solved = C.resolve(near, C.collisions(near.join(opened, C.COLL_KEY, "left_semi")), ops, apis)
    carried = before["resolved"].join(opened, C.COLL_KEY, "left_anti").join(paths, PATH, "left_anti")
    resolved = materialize(carried.select(*solved.columns).unionByName(solved), "resolved")

    # 3. findings
    there = paths.union(opened.select(*PATH)).distinct()
    whose = cands.join(there, PATH, "left_semi").select("service_key").union(services).distinct()
    whose = materialize(whose, "touched_services")
    rows = cands.join(whose, "service_key", "left_semi")
    found = C.classify(rows, C.losers(rows, resolved))
    classified = materialize(before["classified"].join(whose, "service_key", "left_anti").select(*found.columns)
                             .unionByName(found), "classified")
    return {"candidates": cands, "resolved": resolved, "classified": classified, "touched": rows.select(*KEY)}
