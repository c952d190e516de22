"""Run every registered query through the noop sink and print its wall time.

usage: python tests/run_all.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from solera.plans.registry import QUERIES  # noqa: E402
from solera.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or sorted(QUERIES)
    spark = build_session(master="local[8]", shuffle_partitions=16)
    total, bad = 0.0, []
    for n in names:
        t0 = time.perf_counter()
        try:
            QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
            dt_ = time.perf_counter() - t0
            total += dt_
            print(f"{dt_:7.2f}s  {n}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad.append(n)
            print(f"ERROR    {n}: {str(e).splitlines()[0][:300]}", flush=True)
    print(f"total {total:.1f}s, errors {bad}")
