"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of parquet tables; BENCH_CPUS: local cores; BENCH_QUERIES: comma-separated
names instead of the default list. Each query runs once to warm up; then a short one runs three
times, of which the median counts, and a longer one once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from litsieve.queries.registry import QUERIES
from litsieve.session import get_session

HEADLINE = (
    "normalize_text", "normalize_text_tagged", "remove_stopwords", "normalize_stemmed",
    "term_counts", "sparse_vocab", "tfidf", "class_term_frequency", "class_weights",
    "split_train_validate_test", "split_exact", "screening_agreement", "bibliography_clean",
    "title_merge", "type_frequency", "link_normalize", "nb_predict", "nb_metrics",
    "nb_feature_curve", "nb_learning_curve", "nb_kfold_tuning", "best_params", "knn_predict",
    "knn_k_curve", "knn_embeddings", "svm_metrics", "svm_cost_curve",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
    }
    spark = get_session(f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        warm = run(spark, name, folder)
        runs = [run(spark, name, folder) for _ in range(3 if warm < 2.5 else 1)]
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    result = {
        "metric": "total_query_seconds",
        "value": total,
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
