"""Times of the registered queries: one JSON line.

``BENCH_SF_DIR`` is the data, ``BENCH_CPUS`` the number of cores; ``BENCH_QUERIES`` may name some
queries (comma list). Every query runs in full into a sink that drops the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from postmill.plans import catalog
from postmill.session import build


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build("bench", f"local[{cpus}]", {
        "spark.ui.enabled": "false",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": cpus,
    })
    spark.sparkContext.setLogLevel("ERROR")
    # Session start and the first Python workers are not part of any query.
    spark.range(1000).repartition(int(cpus)).mapInArrow(lambda it: it, "id long").count()
    times = {}
    for name, run in catalog.QUERIES.items():
        if wanted and name not in wanted:
            continue
        begin = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total time of all queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
