"""Times the headline queries at one scale and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "recommend_topk",
    "recommend_prefilter",
    "recommend_postfilter",
    "recommend_clusters",
    "score_max",
    "explain_references",
    "explain_features",
    "generate_sessions",
    "tfidf",
    "svd_embedding",
    "preprocess",
    "synonyms",
    "ngrams",
    "filter_chain",
    "text_profile",
    "quantile_nearest",
    "search_page",
    "suggest_names",
    "wishlist_state",
    "rec_upsert",
]


def main() -> None:
    from shelfwise.session import build_session
    from suite.all_queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    conf = {"spark.sql.shuffle.partitions": str(max(8, int(cpus) if cpus.isdigit() else 8)), "spark.driver.memory": "20g"}
    spark = build_session(f"local[{cpus}]", "bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    # one small query first, so that the start of the session and of its Python
    # workers is not timed
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    nations.mapInArrow(lambda batches: batches, nations.schema).count()
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
