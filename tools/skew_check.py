"""Skew check for the refusing ledger fold.

Takes the movements of a test-data directory and moves every third line
item onto product 1 (one product then holds a third of all rows), runs
``ledger_apply`` with n chunks, compares every balance with a sequential
Python fold of the same rows, and reports how the hot product was spread
over chunks and the task-time spread of the fold's stages (event log).

usage: python tools/skew_check.py [sf_dir] [n_chunks]
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    n = int(sys.argv[2]) if len(sys.argv) > 2 else 32
    ev_dir = tempfile.mkdtemp(prefix="skew-ev-")
    from pyspark.sql import functions as F
    from stockspark.operators import ledger as L
    from stockspark.session import get_session
    from stockspark.sources.views import Views
    spark = get_session("local[8]", n, extra={"spark.eventLog.enabled": "true",
                                              "spark.eventLog.dir": ev_dir,
                                              "spark.driver.memory": "8g"})
    v = Views(spark, sf)
    mv = v.movements.withColumn(
        "product_id", F.when(F.col("ord_key") % 3 == 0, F.lit(1)).otherwise(F.col("product_id")))
    t0 = time.time()
    led = L.ledger_apply(mv, n_chunks=n)
    got = led.select("product_id", "created_at", "ord_key", "ord_line", "signed_qty",
                     "balance_after", "accepted").toPandas()
    secs = time.time() - t0
    chunks = L.chunk_movements(mv.filter(F.col("product_id") == 1), n_chunks=n)
    got = got.sort_values(["product_id", "created_at", "ord_key", "ord_line"])
    # sequential reference fold, product by product
    bad = 0
    for pid, g in got.groupby("product_id", sort=False):
        bal = 0
        for x, after, ok in zip((g.signed_qty * 100).astype("int64"),
                                (g.balance_after * 100).astype("int64"), g.accepted):
            nb = bal + x
            exp_ok = nb >= 0
            if exp_ok:
                bal = nb
            bad += (bal != after) or (exp_ok != ok)
    hot_rows = int((got.product_id == 1).sum())
    full = L.chunk_movements(mv, n_chunks=n)
    per_chunk = (full.filter(F.col("product_id") == 1).groupBy("chunk").count()
                 .agg(F.count("*").alias("chunks"), F.max("count").alias("max_rows"))).first()
    spark.stop()
    # task durations of the fold's Python stages
    import zstandard
    durs = []
    for f in glob.glob(os.path.join(ev_dir, "*", "*")) + glob.glob(os.path.join(ev_dir, "*")):
        if os.path.isdir(f) or "appstatus" in f:
            continue
        raw = open(f, "rb").read()
        txt = (zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read().decode()
               if f.endswith(".zstd") else raw.decode())
        for line in txt.splitlines():
            d = json.loads(line)
            if d.get("Event") == "SparkListenerTaskEnd" and d["Task Info"].get("Finish Time"):
                ti = d["Task Info"]
                durs.append((d["Stage ID"], ti["Finish Time"] - ti["Launch Time"]))
    by_stage = {}
    for s, dms in durs:
        by_stage.setdefault(s, []).append(dms)
    worst = max(by_stage.values(), key=lambda xs: max(xs))
    print(json.dumps({
        "rows": len(got), "hot_product_rows": hot_rows, "mismatches": int(bad),
        "hot_product_chunks": per_chunk.chunks, "max_rows_in_one_chunk": per_chunk.max_rows,
        "n_chunks": n, "fold_seconds": round(secs, 1),
        "slowest_stage_task_ms": {"max": max(worst), "median": sorted(worst)[len(worst) // 2],
                                  "tasks": len(worst)}}))
    del chunks


if __name__ == "__main__":
    main()
