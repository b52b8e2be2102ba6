"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
number of local cores, BENCH_QUERIES an optional comma-separated selection.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from creditloom.session import build_session, default_parallelism  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "bureau_features", "bureau_features_per_loan", "previous_risk", "pos_risk", "installment_risk",
    "card_risk", "previous_union_merge", "previous_full_outer", "application_features",
    "application_features_approx", "gold", "integrated", "bureau_credit", "delinquency",
    "installment_payment", "credit_card", "impute_median_exact", "impute_median_approx",
    "impute_mode", "null_profile", "dedup_by_key", "clean_installments", "join_detail",
    "validate_failing", "rate_by_contract", "annuity_distribution", "gap_extremes_union",
    "identity_age", "utilization_group", "trend_group", "composite_score", "late_bucket",
    "card_utilization_bucket",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = default_parallelism()
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__ui__enabled="false",
                          spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    # The first run of a query pays for code generation; the better of two counts, both are reported.
    first = {name: round(run(name), 3) for name in chosen}
    seconds = {name: min(first[name], round(run(name), 3)) for name in chosen}
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": int(cpus), "first_run": first}))


if __name__ == "__main__":
    main()
