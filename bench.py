"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.catalog import load
from tidemark.session import local_session

HEADLINE = [
    "review_queue_flagship", "join1_best_overlap", "join2_overlap_evidence", "join3_attribution", "join4_uncovered_reference", "join6_gap_recovery",
    "join7_nearest_assets", "join9_offset_lookup", "join18_priority_coalesce", "win1_run_length", "win3_merge_intervals", "win4_coverage_gaps",
    "win5_padded_sessions", "win6_scene_boundaries", "win10_snap_windows", "win12_keep_first", "win14_repair_durations", "win15_push_forward",
    "win16_split_layout", "aud1_segment_issues", "aud2_structure_issues", "aud4_transcript_warnings", "aud5_pair_preservation", "agg1_qc_rollup",
    "agg4_source_quality", "agg6_witness_fusion", "agg9_slot_arbitration", "agg12_candidate_decision", "agg14_pairwise_wilson", "agg18_combined_gate",
    "agg23_stream_risk", "agg31_lineage_edges", "agg33_contract_violations", "smp2_stratified_rounds", "top1_review_queue",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    picked = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, "bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    # one query first, so that no timed one pays for the start
    queries["agg18_combined_gate"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in picked:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rstrip("/").split("sf")[-1]}))


if __name__ == "__main__":
    main()
