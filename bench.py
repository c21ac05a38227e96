"""Headline queries on the bench tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from larder import build_session  # noqa: E402
from larder.plans.registry import load_all  # noqa: E402

HEADLINE = [
    "insight_filter", "insight_metrics", "facet_metrics", "questions_page", "question_format", "vote_resolve", "rank_candidates",
    "merge_candidates", "merge_by_taxonomy", "import_predictions", "import_run", "cand_category", "cand_product_weight", "taxonomy_closure",
    "deepest_nodes", "refresh_catalog", "delete_images", "dict_match", "dict_match_join", "extract_label", "extract_product_weight",
    "extract_nutrient_mentions", "extract_packager_code", "entity_runs", "knn_join", "knn_join_probes", "knn_vote", "knn_classify",
    "stream_route", "stream_delayed_refresh",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark.read.parquet(f"{folder}/region.parquet").count()  # start-up is not a query
    times: dict[str, float] = {}
    for name in wanted:
        begin = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - begin, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
