"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its median counts. Results go to Spark's
``noop`` sink, so every row is made and none is kept.
"""

from __future__ import annotations

import importlib.util
import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ROWS = 1_000_000


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def orders_config(rows: int):
    from loam.plans.config import from_mapping

    return from_mapping(
        {
            "version": 1,
            "defaults": {"seed": 42},
            "tables": {
                "customers": {"row_count": 150_000, "primary_key": ["id"], "columns": {"id": {"factory": "pk_serial", "data_type": "bigint"}}},
                "orders": {
                    "row_count": rows,
                    "primary_key": ["id"],
                    "columns": {
                        "id": {"factory": "pk_serial", "data_type": "bigint"},
                        "customer_id": {"factory": "fkref", "params": {"target": "customers.id"}, "data_type": "bigint"},
                        "status": {"factory": "enum_value", "params": {"values": ["pending", "paid", "shipped"]}},
                        "total": {"factory": "amount"},
                        "created_at": {"factory": "timestamp", "data_type": "timestamptz"},
                        "notes": {"factory": "string"},
                    },
                },
            },
        }
    )


def cases():
    from loam.operators.emit import insert_batches
    from loam.operators.generate import Generator
    from loam.queries import QUERIES

    def orders(spark, hash="md5", row=False):
        g = Generator(spark, orders_config(ROWS), hash=hash, partitions=int(CPUS) * 2)
        return g.run(keep_row=row).tables["public.orders"]

    out = {
        "generate_1m_rows": lambda s, d: orders(s),
        "generate_1m_rows_xxhash": lambda s, d: orders(s, "xx"),
        "script_1m_rows": lambda s, d: insert_batches(orders(s, row=True), "public.orders"),
    }
    for name in ("fk_sample_recompute", "fk_sample_join", "unique_resample_rounds", "unique_permutation_fill", "unique_first_wins", "audit_pk_unique", "audit_unique_composite", "audit_fk_orphans", "audit_check_constraints", "audit_exclude_overlap", "audit_fanout", "emit_literals", "emit_insert_batches"):
        out[name] = QUERIES[name]
    if importlib.util.find_spec("loam.llm") and importlib.util.find_spec("loam.llm.queries"):
        from loam.llm.queries import QUERIES as CORPUS

        for name in ("op1_best_fit_packing", "op2_line_dedup", "op3_pii", "op4_exact_dedup", "op7_url_filter", "op8_bpe", "op10_simhash"):
            out[name] = CORPUS[name]
    return out


def main() -> None:
    spark, seconds = session(), {}
    for name, f in cases().items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            f(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median warm seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "cpus": CPUS,
                "generated_rows_per_second": round(ROWS / seconds["generate_1m_rows"]),
                "script_rows_per_second": round(ROWS / seconds["script_1m_rows"]),
            }
        )
    )


if __name__ == "__main__":
    main()
