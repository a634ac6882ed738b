"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints one JSON line with seconds per query
(wall clock of a full collect, session start excluded).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chafe.plans.queries import QUERIES  # noqa: E402
from chafe.session import build_session  # noqa: E402

HEADLINE = [
    "friction_by_group",      # clean -> lexicon score -> group summary (documents)
    "friction_by_agent",      # raw tables -> keys, joins, bots, clean -> score -> summary
    "kruskal_agents",         # distributed average ranks + H over the item pipeline
    "kruskal_events",
    "mann_whitney_pairs",
    "spearman_by_group",
    "chi2_lang_source",
    "box_stats",
    "histogram",
    "density",
    "ctfidf_top",
    "model_score",            # Arrow-batched predictor path
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", max(8, 2 * cpus),
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "12g")})
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in names:
        t0 = time.perf_counter()
        rows[name] = len(QUERIES[name](spark, sf_dir).collect())
        times[name] = round(time.perf_counter() - t0, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
