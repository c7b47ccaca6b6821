"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line. ``build_bank`` is the lineitem -> traces -> fault
injection job including its checkpoint; every other query starts from that
materialized bank (or from the reward log), runs to completion through the
``noop`` sink (no collection to the driver) and reports the median of three
warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultlens.plans import bindings as B  # noqa: E402
from faultlens.plans import queries as Q  # noqa: E402
from faultlens.session import get_spark  # noqa: E402

HEADLINE = [
    "flagship",          # stored bank -> baseline agent -> reward -> mean by level
    "score_server",      # gate + server reward on drawn answers joined to truth
    "parse_strict",      # answer parsing (JSON via VARIANT + regex fallback)
    "replay",            # two-turn negotiation replay
    "audit_bank",        # audit bundle
    "rolling_curve",     # rolling curves on the reward log
    "curriculum_env",    # curriculum replay (w = 100)
    "grade",             # one index over keys, three rows picked
    "sample_cyclic",     # as many draws as the bank has rows
    "render_prompt",     # both prompt wordings
    "score_completions",  # completion texts -> reward log of four runs
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    os.environ.setdefault("FAULTLENS_DRIVER_MEMORY", "8g")
    spark = get_spark()
    timings: dict[str, float] = {}

    t0 = time.time()
    bank = B.lineitem_bank(spark, sf_dir, Q.SEED)
    n_episodes = bank.count()
    timings["build_bank"] = round(time.time() - t0, 3)

    for name in HEADLINE:
        fn = Q.REGISTRY[name]
        run(fn(spark, sf_dir))  # warm-up
        runs = []
        for _ in range(3):
            t = time.time()
            run(fn(spark, sf_dir))
            runs.append(time.time() - t)
        timings[name] = round(statistics.median(runs), 3)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "episodes": n_episodes,
        "cpus": int(os.environ.get("BENCH_CPUS", "8")),
    }))


if __name__ == "__main__":
    main()
