"""Time the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import re
import time

from quarry.catalogue import QUERIES
from quarry.session import local_session

HEADLINE = [
    "knn_cosine_topk", "bm25_topk", "hybrid_search", "rrf_weighted", "graph_prune_boost", "one_hop_expand", "collapse_by_group",
    "dedupe_best", "budget_prefix_by_source", "module_rollup", "lexical_terms", "lexical_weight", "estimate_tokens", "mrr_hit_at_k",
    "co_change_suppliers", "co_change_parts", "undirected_neighbours", "callers_four_hops", "resolve_priority", "changed_files_diff",
    "sliding_line_windows", "tumbling_line_windows", "gap_sessions_by_user", "innermost_owner", "leading_comment_strip",
    "import_block_strip", "content_hash", "median_by_lang", "code_references", "code_edges",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="16g")
    QUERIES["estimate_tokens"](spark, folder).count()
    seconds = {}
    for name in HEADLINE:
        begun = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begun, 3)
    sf = re.search(r"sf([\d.]+)", folder)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(sf.group(1)) if sf else folder}))


if __name__ == "__main__":
    main()
