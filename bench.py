"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run to completion into the no-op sink, so every column of every row is computed and
nothing is gathered on the driver.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from medloom.plans import catalog  # noqa: E402
from medloom.session import build_session  # noqa: E402

HEADLINE = [
    "star_overview", "cluster_by_system", "profiles_nested", "enrichment_lift", "llr_table", "set_algebra",
    "dq_duplicate_rate", "dq_text_uniqueness", "dq_conflicts", "dq_mutual_information",
    "prj_pseudonym", "prj_scrub", "prj_age_sex", "txt_split", "txt_doc_freq", "txt_backoff",
    "lnk_phonetic", "lnk_preference_pick", "latest_consent", "upsert_last", "streak", "timeline_recurring", "weekly_profile",
    "eligible_cases", "time_split", "k_anonymous", "triage_rules", "imbalance_softmax", "differential_topk", "info_gain",
    "idf_match", "npmi_edges", "jmi_pairs", "nb_posterior", "cramers_v", "mann_whitney", "auc", "src_fingerprint",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.driver.bindAddress": "127.0.0.1", "spark.driver.host": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in catalog.QUERIES]
    catalog.QUERIES["star_overview"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
            "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", "")}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
