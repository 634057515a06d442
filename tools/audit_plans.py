"""Flag plan nodes that would hurt at scale, query by query.

    python tools/audit_plans.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

FLAGS = [
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "Exchange SinglePartition",
    "SortAggregate",
    "FlatMapGroupsInPandas",
    "FlatMapCoGroupsInPandas",
    "MapInPandas",
    "ArrowEvalPython",
    "Window",
]


def main():
    from cellframe.registry import REGISTRY
    from cellframe.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8", app="audit")
    # Plan joins as if nothing were small enough to broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, q in REGISTRY.items():
        if names and name not in names:
            continue
        plan = q.run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        if names:
            print(plan)
        hits = {f: len(re.findall(rf"(?m)[-+: ]{f}\b", plan)) for f in FLAGS}
        exchanges = len(re.findall(r"Exchange (?:hash|range)partitioning", plan))
        shown = ", ".join(f"{k} x{v}" for k, v in hits.items() if v)
        print(f"{name:28s} shuffles {exchanges:2d}  {shown}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
