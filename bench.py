"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``. Every query runs in full into a sink
that drops its rows; the better of two runs counts, so code generation is not measured. Searches of stored indexes are
also timed apart from the writing of the index (``*_built``), which is given under its own name.
"""

from __future__ import annotations

import json
import os
import time

from checks import inputs as I
from checks.registry import QUERIES, K
from citeflow.operators import index as ix
from citeflow.operators import retrieval as rt
from citeflow.operators import vector_index as vx
from citeflow.session import local_session, scratch_folder

HEADLINE = (
    "keyword_search", "semantic_search", "semantic_search_ann", "hybrid_first_seen",
    "hybrid_boosted", "postings", "term_stats", "context_bot", "citations_by_url", "chunk_documents",
    "corpus_from_pages", "log_tail", "log_tail_by_source", "dedupe_by_text", "top_k_per_query",
    "history_render", "query_route", "list_spacing", "citation_symbols", "block_segment",
    "fallback_text", "channel_history_state", "channel_history_state_batch", "deletion_plan",
    "answer_web", "answer_bot", "answer_bot_pages", "keyword_search_indexed", "answer_stream",
)


def sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def seconds(work) -> float:
    start = time.time()
    work()
    return time.time() - start


def stored(spark, sf: str) -> dict[str, float]:
    """Writing the indexes, and searching them once written."""
    terms, vectors = scratch_folder(spark, "index"), scratch_folder(spark, "vectors")
    times = {
        "term_index_write": seconds(lambda: ix.write_term_index(I.corpus(spark, sf), terms)),
        "vector_index_write": seconds(lambda: vx.write_vector_index(I.stored_vectors(spark, sf), vectors)),
    }
    index, cells = ix.read_term_index(spark, terms), vx.read_vector_index(spark, vectors)
    searches = {
        "keyword_search_built": lambda: sink(rt.keyword_search_indexed(index, I.questions(spark, sf), K)),
        "vector_search_built": lambda: sink(vx.search(cells, I.question_vectors(spark, sf), K)),
    }
    return times | {name: min(seconds(work) for _ in range(2)) for name, work in searches.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    times = {name: min(seconds(lambda n=name: sink(QUERIES[n](spark, sf))) for _ in range(2)) for name in HEADLINE}
    total = sum(times.values())
    times |= stored(spark, sf)
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(total, 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
