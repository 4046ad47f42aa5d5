"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

The tables that the queries read are written first and timed as `atlas_build`; a query then costs what it reads and does."""

from __future__ import annotations

import json
import os
import time

from lociq import atlas
from lociq.plans import annotations, bubbles, catalogue, formats, hierarchy, reading, selections, sites, strings, structure, trees, views  # noqa: F401 (each registers its queries)
from lociq.session import session


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, int(cpus) if cpus.isdigit() else 8, "6g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the JVM's workers
    took, begun = {}, time.time()
    atlas.build(spark, sf_dir)
    took["atlas_build"] = round(time.time() - begun, 3)
    for name, f in catalogue.QUERIES.items():
        begun = time.time()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begun, 3)
    sf = sf_dir.rstrip("/").rsplit("/", 1)[-1].removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the graph queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
