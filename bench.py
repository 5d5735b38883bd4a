"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from folioground import registry
from folioground.registry import evidence, flows, retrieval
from folioground.session import local_session

HEADLINE = [
    "search_normalisation", "page_chunks", "ingest_vectors", "index_build",
    "vector_top_k", "keyword_top_k", "bm25_ranking", "hybrid_search_chunks", "answers_end_to_end",
    "known_relevance", "claim_checks", "citation_checks", "question_understanding", "request_verdicts",
    "duplicate_warnings", "version_conflicts", "document_listing", "processing_summary", "reindex_everything",
    "eligibility_screening", "service_levels", "audit_rollup", "search_sessions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries, _ = registry.load()
    queries = dict(queries)
    # The index over all chunks is built once, timed on its own, and read by the searches after it.
    queries["index_build"] = lambda s, d: flows.index_tables(s, d)[2].select("vector_id")
    # Adapter tables, retrieved passages for the claim checks, and JVM warm-up: not timed.
    retrieval.passage_corpus(spark, sf_dir)
    if not only or {"claim_checks", "citation_checks"} & set(only):
        evidence.shown_passages(spark, sf_dir)
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
