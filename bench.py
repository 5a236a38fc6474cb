"""Benchmark: median time of the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma-separated names; default: headline list).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from veridraft.plans.registry import all_queries
from veridraft.session import clean_up, local_session

HEADLINE = [
    "a35_pick_flag", "a37_review_queue", "a41_dashboard", "a43_rescore", "a43_rescored_queue", "a44_result_summary",
    "a50_join_flags", "a51_evidence_source_cited", "a56_match_paragraphs", "a60_paragraph_view", "a62_heatmap", "a62_heatmap_ten_sections",
    "a63_apply_decisions", "a67_process_decisions", "a71_verification_trail", "a72_stage_board",
    "b01_waterfall", "b02_score_progression", "b03_location_heatmap", "b04_canonical_text",
    "b05_extract_claims", "b06_bm25_top_k", "b07_vector_top_k", "b08_source_precedence",
    "b09_claim_verdicts", "b10_claim_root", "b11_policy_rollup", "b12_live_scores",
    "b13_integrity_report", "b14_live_stages", "b15_session_activity", "e3_audit_documents",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, partitions, os.environ.get("BENCH_MEMORY", "12g"))
    registered = all_queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times: dict[str, float] = {}
    for name in names:
        once(name)  # warm-up
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    clean_up(spark)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
