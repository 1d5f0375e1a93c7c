"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "reception_gate",
    "format_gate",
    "content_gate",
    "extraction_cascade",
    "clean_text",
    "repeated_lines",
    "parse_responses",
    "enrichment_retry",
    "exact_dedup",
    "text_near_dedup",
    "near_dedup",
    "nearest_neighbour",
    "detect_language",
    "review_queue",
    "apply_decisions",
    "merge_patches",
    "event_stream_until_done",
    "ingest_cascade",
    "enrich",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from inkgate.catalog import QUERIES
    from inkgate.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # One untimed pass over the smallest tables: class loading, code generation and Python
    # worker start-up are paid once per session, not once per query.
    warm = Path(folder).parent / "sf0.001"
    warmed = warm.exists()
    for name in names if warmed else ():
        QUERIES[name](spark, str(warm)).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    report = {
        "metric": "total_wall_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "documents": docs,
        "warmed_up": warmed,
    }
    if "ingest_cascade" in seconds:
        report["ingest_docs_per_sec"] = round(docs / seconds["ingest_cascade"], 1)
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
