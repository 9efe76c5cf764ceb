"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from batchwright.operators import flat  # noqa: E402
from batchwright.plans.index import with_index  # noqa: E402
from batchwright.queries import graphs, rows  # noqa: E402
from batchwright.queries.tables import MODEL, none_of, read  # noqa: E402
from batchwright.session import local_session, release  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
QUERIES = {
    **{n: rows.QUERIES[n] for n in ("insert_isolated", "insert_fk_check", "update_rows", "delete_rows", "upsert_match_single", "upsert_retry_as_update", "failure_reasons", "batch_metrics")},
    **{n: graphs.QUERIES[n] for n in ("graph_insert_outcome", "graph_update_orphans", "graph_delete_cascade", "m2m_link_diff")},
}


def failure_curve(spark) -> dict[str, float]:
    """Inserting the same lines with 0, 10 and 25 of 100 made invalid: the time should not depend on the rate."""
    lines = with_index(read(spark, SF_DIR, "lineitem"), dense=False)
    out = {}
    for rate in (0, 10, 25):
        batch = lines.withColumn("l_discount", F.when(F.pmod(F.xxhash64("__idx"), F.lit(100)) < rate, 1.0).otherwise(0.0))
        began = time.perf_counter()
        flat.insert(batch, none_of(batch), MODEL, "lineitem").metrics().collect()
        out[f"insert_bad_{rate}pct"] = round(time.perf_counter() - began, 3)
    return out


def main() -> None:
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    rows.QUERIES["insert_isolated"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # compiles, warms the file cache
    took = {}
    for name, query in QUERIES.items():
        began = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        release(spark)
    took |= failure_curve(spark)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
