"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from quarry import queries as engine
from quarry.session import session

HEADLINE = ["x05_metadata", "x03_x04_encoding", "a01_summary", "x11_a04_format", "l01_l09_token_counts", "g18_move", "g10_items", "j01_j03_sem001_sem003_sem010", "i01_i08_opcodes", "a06_x29_ir_text", "b04_java_sources"]
LLM = [
    "op1_token_records", "op2_mixing", "op3_simhash", "op4_fingerprints", "op5_exact_dedup", "op6_personal_data", "op7_repeats", "op8_preferences", "op9_quality", "op10_packing",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = {n: engine.QUERIES[n] for n in HEADLINE}
    try:
        from quarry.llm import queries as llm

        found |= {n: llm.QUERIES[n] for n in LLM}
    except ImportError:
        pass
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name, f in found.items():
        began = time.time()
        f(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
