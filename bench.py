"""Time the headline graph queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

``queries`` are on plain graphs. ``compression`` has what the grammar of the event chain costs
and saves: seconds to compress, prune and order, the ratio of sizes, and the same algorithm on the
plain graph, with rules expanded once, and level by level.
"""

import json
import os
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from lacewing import build_session
from lacewing.datasets import event_chain
from lacewing.operators import filter_rules, pagerank, repair, wcc
from lacewing.queries import queries

HEADLINE = ("degree", "pair_frequency", "bfs_levels", "sssp", "wcc", "cc_directed", "topo_levels", "pagerank_10", "pagerank_bipartite_10", "hits_5")


def timed(work: Callable[[], Any]) -> tuple[float, Any]:
    began = time.time()
    out = work()
    if isinstance(out, DataFrame):
        out.write.format("noop").mode("overwrite").save()
    return round(time.time() - began, 2), out


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    all_of = queries()
    timed(lambda: all_of["degree"](spark, folder))
    took = {name: timed(lambda name=name: all_of[name](spark, folder))[0] for name in HEADLINE}

    cost: dict[str, Any] = {}
    plain = event_chain(spark, folder).kept
    cost["compress"], full = timed(lambda: repair(plain))
    cost["prune"], kept = timed(lambda: filter_rules(full, 0))
    cost["order"], _ = timed(lambda: kept.rule_order)
    cost |= {"edges": plain.edges.count(), "rules": kept.meta.rule_cnt, "rules_before": full.meta.rule_cnt, "levels": kept.max_level + 1, "ratio": round(kept.ratio(), 3), "ratio_before": round(full.ratio(), 3)}
    for name, run in (("pagerank_10", lambda g: pagerank(g, eps=None)), ("wcc", wcc)):
        for kind, g in (("plain", plain), ("flat", kept), ("levels", kept.scheduled("levels"))):
            cost[f"{name}_{kind}"] = timed(lambda run=run, g=g: run(g))[0]
    print(json.dumps({"metric": "graph queries, total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "compression": cost, "sf": folder.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
