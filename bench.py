"""Headline queries, timed: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import catalog
from tidemark.session import local_session

HEADLINE = (
    "build_evidence", "search_chunks", "bm25", "search_facts", "tokenize", "chunk_text", "validate_page", "simhash64", "simhash_neighbours",
    "vote", "reconcile", "duplicate_groups", "merge_seed_facts", "upsert_document", "trust_score", "gap_judge", "kb_report", "html_extract",
    "cosine_topk", "session_window",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, os.environ.get("BENCH_MEMORY", "8g"))
    queries = catalog.queries()
    try:
        from tidemark.llm import registry

        queries |= registry.QUERIES
    except ImportError:
        pass
    names = [n for n in queries if n in HEADLINE or n.startswith("op")]
    queries["stats"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the executors
    took = {}
    for name in names:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
