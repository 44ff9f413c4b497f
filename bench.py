"""Headline queries at ``$BENCH_SF_DIR``; prints one JSON line with warm seconds per query (cold ones beside them)."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from noviscan import get_session
from noviscan.catalog import QUERIES

HEADLINES = {
    "verdict_per_source": "agg1_verdict_per_source",
    "topk_broadcast": "join1_topk_similarity_broadcast",
    "topk_cells_exact": "join1_topk_similarity_cells",
    "topk_cells_probe": "join1_topk_similarity_probe",
    "threshold_calibration": "agg10_threshold_calibration",
    "keyword_search": "srt1_keyword_search",
    "keyword_search_many": "srt1_keyword_search_many",
    "keyword_index_build": "srt1_keyword_index_tokens",
    "extractive_summary": "srt2_extractive_summary",
    "link_resolution": "join3_wikilink_resolution",
    "incremental_diff": "join8_incremental_diff",
    "segments": "src4_markdown_segments",
    "segment_and_chunk": "prj6_chunks_for_scoring",
    "boilerplate": "flt1_boilerplate_segment",
    "daily_counters": "agg19_daily_counters",
    "claim_duplicates": "set7_near_duplicate_claiming",
    "merge_proposals": "snk6_merge_proposals_status",
    "run_state_stream": "str3_run_state_stream",
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name, key in HEADLINES.items():
        for times in (cold, warm):
            start = time.perf_counter()
            run(QUERIES[key](spark, sf))
            times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm total", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "cold": cold, "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
