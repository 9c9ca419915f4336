"""Headline queries at one scale; prints a JSON line that grows with every query, the last one complete.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_RUNS the measured runs of
each query (the median counts).  Every query is run to a no-op sink, so all columns
of all rows are computed; the views that queries share are written before, under
``views`` in the output.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from combirisk.plans import views  # noqa: E402
from combirisk.plans.catalog import QUERIES  # noqa: E402
from combirisk.session import local_session  # noqa: E402

HEADLINES = [
    "p13_phenotype_tags",
    "p19_rule_severity",
    "p24_hybrid_recalibration",
    "p25_evidence_class",
    "j2_regimen_pairs",
    "j18_entity_mentions",
    "a4_item_profiles",
    "a12_spearman",
    "w8_sorted_findings",
    "g2_edges",
    "g5_betweenness",
    "g10_pagerank",
    "g14_clustering",
    "h1_regimen_network_risk",
    "i1_same_class_alternatives",
    "i5_similar_items",
    "i6_safe_alternatives",
    "e6_classification_metrics",
    "e15_pair_signals",
    "e17_faithfulness",
    "e18_rouge_n",
    "h2_five_part_risk",
    "j13_shared_attributes",
    "h8_decomposition",
    "i12_lower_index_alternatives",
    "i9_alternative_score",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINES
    spark = local_session(cpus, cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    seconds = {}

    def report(complete: bool) -> None:
        print(
            json.dumps(
                {
                    "metric": "total_seconds", "value": round(sum(seconds.values()), 2), "unit": "sec", "queries": seconds,
                    "sf": os.path.basename(folder).removeprefix("sf"), "complete": complete, "cpus": cpus, "shuffle_partitions": cpus,
                }
            ),
            flush=True,
        )

    start = time.time()
    for view in (views.interactions, views.regimens, views.tagged_edges, views.item_metrics, views.side_effects, views.proteins, views.diseases, views.pathways):
        view(spark, folder)
    seconds["views"] = round(time.time() - start, 2)
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            start = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(statistics.median(runs), 2)
        # A line after every query, the last one complete: a limit from outside finds what was measured.
        report(name == names[-1])


if __name__ == "__main__":
    main()
