"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from tetrarank import workloads  # noqa: E402

HEADLINES = [
    "bm25_search", "dense_search_cosine", "user_item_cosine", "hybrid_rerank", "candidate_table", "cascade_scores", "proxy_top_items",
    "difference_features", "combined_features", "grouped_split", "balanced_positions", "model_report", "ranker_report", "gating_sweep",
    "list_metrics", "expert_score_table", "feature_statistics", "chunk_table", "lexicon_emotions", "emotion_index_from_json",
]

#: Timed apart from the total: the search of many queries over a kept index of cells.
OTHERS = ["dense_cells_cosine"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = workloads.all_queries()
    for name in ("part_histogram", "dense_search_ip"):  # start the JVM code paths and the Python workers
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINES + OTHERS:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    others = {name: times.pop(name) for name in OTHERS}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "others": others, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
