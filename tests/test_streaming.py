import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from helpers import fold
from stockspark.streaming import jobs as S

T0 = dt.datetime(2024, 1, 1)


def test_stream_ledger_over_several_micro_batches_equals_batch_fold(spark):
    d = tempfile.mkdtemp(prefix="stream-in-")
    qs = {1: [5, -9, 3, -2, 8, -7, -7, 1], 2: [-1, 2, -3, 4]}
    rows = [(p, T0 + dt.timedelta(hours=i), i, 1, "stock_in" if q > 0 else "stock_out",
             Decimal(abs(q)), Decimal(q)) for p, v in qs.items() for i, q in enumerate(v)]
    schema = ("product_id long, created_at timestamp_ntz, ord_key long, ord_line int, "
              "type string, quantity decimal(12,2), signed_qty decimal(12,2)")
    df = spark.createDataFrame(rows, schema)
    # three files in time order -> three micro-batches
    for k, (a, b) in enumerate([(0, 3), (3, 6), (6, 99)]):
        df.filter((F.col("ord_key") >= a) & (F.col("ord_key") < b)).coalesce(1) \
          .write.parquet(os.path.join(d, f"part{k}"))
    src = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
           .option("recursiveFileLookup", "true").parquet(d))
    out = S.run_ledger(src).rows().collect()
    got = {(r.product_id, r.ord_key): (r.balance_after, r.accepted) for r in out}
    for p, v in qs.items():
        for i, (_, after, ok) in enumerate(fold([Decimal(x) for x in v])):
            assert got[(p, i)] == (after, ok)


MOVES = ("product_id long, created_at timestamp_ntz, ord_key long, ord_line int, "
         "type string, quantity decimal(12,2), signed_qty decimal(12,2)")


def _moves(spec):
    """spec: {product: [signed quantities by hour]}."""
    return [(p, T0 + dt.timedelta(hours=i), i, 1, "stock_in" if q > 0 else "stock_out", Decimal(abs(q)), Decimal(q))
            for p, v in spec.items() for i, q in enumerate(v)]


def _files(spark, rows, schema, files):
    """Parquet files of the rows that the predicates pick, oldest first; returns a reader of n files a batch."""
    d = tempfile.mkdtemp(prefix="stream-files-")
    for k, pick in enumerate(files):
        spark.createDataFrame([r for r in rows if pick(r)], schema).coalesce(1).write.parquet(os.path.join(d, f"f{k}"))
        os.utime(os.path.join(d, f"f{k}"), (k + 1, k + 1))
    return lambda n=1: (spark.readStream.schema(schema).option("maxFilesPerTrigger", n)
                        .option("recursiveFileLookup", "true").parquet(d))


def test_stream_ledger_of_shuffled_files_and_a_restart(spark):
    qs = {1: [5, -9, 3, -2, 8, -7, -7, 1], 2: [-1, 2, -3, 4], 3: [1] * 8}
    rows = _moves(qs)
    src = _files(spark, rows, MOVES, [lambda r, k=k: r[2] % 3 == k for k in (2, 0, 1)])
    name = f"ledger-{os.urandom(4).hex()}"
    real, calls = S.LedgerStore.append, []

    def failing(self, df, batch):
        calls.append(batch)
        if len(calls) == 2:                              # dies after its rows are written and before the batch is done
            real(self, df, batch)
            raise RuntimeError("lost")
        return real(self, df, batch)
    S.LedgerStore.append = failing
    try:
        with pytest.raises(StreamingQueryException):
            S.run_ledger(src(), name)
    finally:
        S.LedgerStore.append = real
    store = S.run_ledger(src(), name)                    # the second batch comes again and adds nothing
    got = {(r.product_id, r.ord_key): (r.balance_after, r.accepted) for r in store.rows().collect()}
    assert got == {(p, i): (after, ok) for p, v in qs.items()
                   for i, (_, after, ok) in enumerate(fold([Decimal(x) for x in v]))}
    per = {r["commit"]: r["n"] for r in store.log.get("rows").groupBy("commit").agg(F.count("*").alias("n")).collect()}
    assert len(per) == 3


def test_alerts_follow_corrections_and_versions(spark):
    """A late receipt withdraws an alert; the minimum that was valid at the movement counts."""
    rows = _moves({1: [10, -8, 20, -3]})
    src = _files(spark, rows, MOVES, [lambda r: r[2] in (0, 1), lambda r: r[2] == 3, lambda r: r[2] == 2])
    products = spark.createDataFrame([(1, "P", "Nos", Decimal(5))], "id long, name string, unit string, "
                                                                    "min_stock_level decimal(12,2)")
    got = S.run_alerts(src(), products).collect()
    assert [(r.ord_key, r.balance_after) for r in got] == [(1, Decimal(2))]
    versions = spark.createDataFrame([(1, T0 + dt.timedelta(hours=2), Decimal(100)), (1, T0, Decimal(1))],
                                     "product_id long, valid_from timestamp_ntz, min_stock_level decimal(12,2)")
    got = S.run_alerts(src(), products, versions).collect()
    assert sorted((r.ord_key, r.min_stock_level, r.level) for r in got) == [
        (2, Decimal(100), "CRITICAL"), (3, Decimal(100), "CRITICAL")]


def test_asof_join_of_hot_keys(spark):
    import random
    from bisect import bisect_right
    from stockspark.operators.asof import asof_join
    rnd = random.Random(3)
    at = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1 if rnd.random() < 0.6 else rnd.randrange(2, 9), at(rnd.randrange(5000)), i) for i in range(1500)]
    rows += [(None, at(3), 2000), (1, None, 2001), (50, at(1), 2002)]
    versions = [(p, at(m), f"v{p}-{m}") for p in range(1, 9) for m in rnd.sample(range(5000), 2 if p > 1 else 300)]
    left = spark.createDataFrame(rows, "k long, t timestamp_ntz, i long")
    right = spark.createDataFrame(versions + [(None, at(1), "x"), (1, None, "y")], "k long, since timestamp_ntz, v string")
    by = {}
    for p, since, v in sorted(versions):
        by.setdefault(p, ([], []))
        by[p][0].append(since)
        by[p][1].append(v)
    for n in (1, 16):
        got = {r.i: r.v for r in asof_join(left, right, "k", "t", "since", n_parts=n).collect()}
        assert len(got) == len(rows)
        for p, t, i in rows:
            k = bisect_right(by[p][0], t) if p in by and t is not None else 0
            assert got[i] == (by[p][1][k - 1] if k else None)


def test_session_gap_boundary(spark):
    rows = [(1, T0), (1, T0 + dt.timedelta(seconds=3600)),
            (1, T0 + dt.timedelta(seconds=7201))]
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    got = sorted(r.events for r in S.user_sessions(ev).collect())
    assert got == [1, 2]      # 3600 s stays in the session, 3601 s opens a new one


def test_audit_ingest_drops_duplicate_event_ids(spark):
    d = tempfile.mkdtemp(prefix="stream-ev-")
    rows = [(1, T0, 5, "click", 1.0, '{"k": 1}'), (1, T0, 5, "click", 1.0, '{"k": 1}'),
            (2, T0 + dt.timedelta(minutes=1), 6, "view", 1.0, '{"k": 2}')]
    ev = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, "
                                     "event_type string, value double, props string")
    ev.coalesce(1).write.parquet(os.path.join(d, "events.parquet"))
    users = spark.createDataFrame([(5, "A B", "admin")], "id long, name string, role string")
    src = spark.readStream.schema(ev.schema).parquet(os.path.join(d, "events.parquet"))
    out = S.run_audit(src, users).collect()
    assert sorted((r.id, r.action, r.user_name) for r in out) == [
        (1, "CLICK", "A B"), (2, "VIEW", "System")]


def test_batch_sessions_split_hot_user_across_partitions(spark):
    import random
    from stockspark.operators.sessions import user_sessions
    rnd = random.Random(1)
    rows, t = [], T0
    for _ in range(3000):                      # one very active user
        t += dt.timedelta(seconds=rnd.choice([10, 600, 3600, 3601, 7200]))
        rows.append((1, t))
    for u in range(2, 30):
        rows.append((u, T0 + dt.timedelta(seconds=u)))
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    got = sorted((r.user_id, r.session_start, r.session_end, r.events)
                 for r in user_sessions(ev, 3600, n_parts=16).collect())
    exp, by = [], {}
    for u, ts in sorted(rows):
        by.setdefault(u, []).append(ts)
    for u, tss in by.items():
        s = e = tss[0]
        n = 1
        for x in tss[1:]:
            if (x - e).total_seconds() > 3600:
                exp.append((u, s, e, n))
                s, n = x, 0
            e = x
            n += 1
        exp.append((u, s, e, n))
    assert got == sorted(exp)


def _event_files(spark, files):
    """One parquet file for each list of (event_id, hour, user), oldest file first."""
    d = tempfile.mkdtemp(prefix="stream-late-")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    for k, rows in enumerate(files):
        data = [(i, T0 + dt.timedelta(hours=h), u, "click", 1.0, '{"k": 1}') for i, h, u in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(os.path.join(d, f"f{k}"))
        os.utime(os.path.join(d, f"f{k}"), (k + 1, k + 1))
    return lambda n: (spark.readStream.schema(schema).option("maxFilesPerTrigger", n)
                      .option("recursiveFileLookup", "true").parquet(d))


LATE = [[(1, 100, 5)], [(2, 101, 5), (1, 100, 5)], [(3, 2, 5)], [(4, 1, 6), (2, 101, 5)], [(5, 3, 5)]]


def test_late_files_lose_no_audit_row(spark):
    users = spark.createDataFrame([(5, "A B", "admin")], "id long, name string, role string")
    src = _event_files(spark, LATE)
    for n in (1, 2, 100):
        assert sorted(r.id for r in S.run_audit(src(n), users).collect()) == [1, 2, 3, 4, 5]


def test_streamed_days_and_sessions_equal_batch_for_any_arrival(spark):
    src = _event_files(spark, LATE)
    flat = [(T0 + dt.timedelta(hours=h), u) for f in LATE for _, h, u in f]
    batch = S.user_sessions(spark.createDataFrame(flat, "ts timestamp_ntz, user_id long"))
    want = sorted(map(tuple, batch.select("user_id", "session_start", "session_end", "events").collect()))
    for n, compact_after in ((1, 2), (1, 50), (100, 50)):
        days = S.run_daily_activity(src(n), compact_after=compact_after).collect()
        assert sorted((r.day, r.events) for r in days) == [("2024-01-01", 3), ("2024-01-05", 4)]
        got = S.run_sessions(src(n), compact_after=compact_after)
        assert sorted(map(tuple, got.select("user_id", "session_start", "session_end", "events").collect())) == want


def test_batch_sessions_without_exchange_reuse(spark):
    import random
    from stockspark.operators.sessions import user_sessions
    rnd = random.Random(2)
    rows = [(1 if rnd.random() < 0.7 else rnd.randrange(2, 6), T0 + dt.timedelta(seconds=rnd.randrange(200_000)))
            for _ in range(3000)]
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert sum(r.events for r in user_sessions(ev, 60, n_parts=8).collect()) == len(rows)
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_sessions_of_cells_bridge_and_split_like_events(spark):
    import random
    from stockspark.operators import sessions as SE
    rnd = random.Random(4)
    rows = [(1 if rnd.random() < 0.5 else rnd.randrange(2, 5), T0 + dt.timedelta(seconds=rnd.randrange(400_000)))
            for _ in range(2500)]
    rows += [(9, T0), (9, T0 + dt.timedelta(seconds=60)), (9, T0 + dt.timedelta(seconds=121))]
    ev = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").withColumn("part", F.col("user_id") % 2 + F.second("ts") % 3)
    want = sorted(map(tuple, SE.user_sessions(ev, 60, n_parts=4).collect()))
    parts = [SE.session_cells(ev.where(F.col("part") == k), 60) for k in range(4)]
    cells = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    got = SE.sessions_of_cells(SE.add_cells(cells), 60, n_parts=9)
    assert sorted(map(tuple, got.collect())) == want
    assert [w[3] for w in want if w[0] == 9] == [2, 1]


def test_repeated_counts_and_late_audit_rows_after_a_crash(spark):
    """A batch that comes again after it was committed adds nothing, to counts or to the audit log."""
    users = spark.createDataFrame([(5, "A B", "admin")], "id long, name string, role string")
    src = _event_files(spark, LATE)
    for run, rows in ((S.run_daily_activity, lambda out: sum(r.events for r in out)),
                      (lambda e, name: S.run_audit(e, users, name), len)):
        name = f"crash-{os.urandom(4).hex()}"
        real = S.CommitLog.commit
        seen = []

        def failing(self, batch):
            real(self, batch)
            seen.append(batch)
            if len(seen) == 3:
                raise RuntimeError("lost after the commit")
        S.CommitLog.commit = failing
        try:
            with pytest.raises(StreamingQueryException):
                run(src(1), name=name)
        finally:
            S.CommitLog.commit = real
        assert rows(run(src(1), name=name).collect()) == (7 if run is S.run_daily_activity else 5)


def test_unread_counts_from_two_streams_in_any_order(spark):
    h = lambda k: T0 + dt.timedelta(hours=k)
    notes = [(1, h(1)), (1, h(5)), (1, h(9)), (2, h(2)), (2, h(2)), (3, h(4)), (4, h(1)), (None, h(1)), (5, None)]
    marks = [(1, h(5)), (2, h(1)), (3, h(9)), (1, h(2)), (6, h(1))]
    n = _files(spark, notes, "user_id long, created_at timestamp_ntz", [lambda r, k=k: notes.index(r) % 3 == k for k in range(3)])
    m = _files(spark, marks, "user_id long, read_at timestamp_ntz", [lambda r: r[0] in (3, 6), lambda r: r[0] in (1, 2)])
    for per in (1, 10):
        got = {r.user_id: r.unread for r in S.run_unread(n(per), m(per)).collect()}
        assert got == {1: 1, 2: 2, 3: 0, 4: 1, 6: 0}
