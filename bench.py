"""Headline timings: prints one JSON line.

Each figure is a full run from the parquet files; nothing is reused between
them except the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from titrant.catalog.labview import POSITIONS_PER_ORDER, lab_rows  # noqa: E402
from titrant.operators import rollup, sections  # noqa: E402
from titrant.plans import reports  # noqa: E402
from titrant.session import local_session, saved  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name, fn):
        start = time.time()
        out = fn()
        took[name] = round(time.time() - start, 3)
        return out

    raw = lab_rows(spark, sf_dir)
    know = timed("dimensions", lambda: reports.knowledge(spark))
    timed("row_sections", lambda: sections.assign_blocks(raw, POSITIONS_PER_ORDER).write.format("noop").mode("overwrite").save())

    def clean():
        c = reports.clean_rows(raw, rows_per_chunk=POSITIONS_PER_ORDER)
        return saved(c.rows, "rows"), saved(c.blocks, "blocks")
    rows, blocks = timed("clean", clean)
    enriched = timed("enrich", lambda: saved(reports.enrich_rows(rows, know, blocks), "enriched"))
    interpreted = timed("interpret", lambda: saved(reports.interpret_rows(enriched), "interpreted"))
    rolled = timed("deduplicate", lambda: reports.roll_up(interpreted, know))
    timed("summary", lambda: rolled.summary.write.format("noop").mode("overwrite").save())
    timed("topics", lambda: rolled.topics.write.format("noop").mode("overwrite").save())
    timed("topic_row_order", lambda: rollup.rank_within_topics(rolled.canonical).write.format("noop").mode("overwrite").save())
    total = sum(took.values())
    n = raw.count()
    print(json.dumps({"metric": "full_report_analysis", "value": round(total, 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "rows": n, "rows_per_sec": round(n / total)}))


if __name__ == "__main__":
    main()
