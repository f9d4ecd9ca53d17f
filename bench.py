"""Time the headline queries: one warm-up run, then the median of three, or a single
run where the warm-up took longer than SLOW seconds.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma separated) change what is run.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from corpusloom.plans import recipes
from corpusloom.plans.index import build, word_gazetteer
from corpusloom.session import build_session

HEADLINE = (
    "line_windows",
    "paragraph_pack",
    "token_windows",
    "code_blocks",
    "html_markdown",
    "html_struct",
    "tfidf_weights",
    "entity_mentions",
    "entity_merge",
    "relation_merge",
    "graph_two_hop",
    "search_naive",
    "search_local",
    "search_global",
    "search_hybrid",
    "vector_topk",
    "chat_pairs",
    "process_summary",
)
RUNS = 3
SLOW = 2.5


def timed(fn) -> float:
    start = time.perf_counter()
    fn()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            recipes.INPUT_PARTITIONS: cpus,  # the given text tables are one row group each
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    def build_index() -> None:
        docs = recipes.table(spark, sf_dir, "documents")
        gazetteer = word_gazetteer(recipes.table(spark, sf_dir, "benchmark"))
        build(docs, gazetteer, recipes.WINDOW_TOKENS)

    recipes.index(spark, sf_dir)
    results = {"index_build": round(timed(build_index), 3)}
    results["layout_build"] = round(timed(recipes.index(spark, sf_dir).lay_out), 3)
    for name in names:
        run = lambda fn=recipes.QUERIES[name]: drain(fn(spark, sf_dir))
        runs = 1 if timed(run) > SLOW else RUNS
        results[name] = round(statistics.median(timed(run) for _ in range(runs)), 3)
        print(name, results[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total warm seconds of the headline queries",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": results,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
