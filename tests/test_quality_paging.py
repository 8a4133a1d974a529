from pyspark.sql import functions as F

from stockspark.operators import paging as PG
from stockspark.operators import quality as Q


def test_unique_and_fk_rules_find_injected_faults(spark):
    p = spark.createDataFrame([(1, "P-0001"), (2, "P-0001"), (3, "P-0003")],
                              "id long, product_code string")
    m = spark.createDataFrame([(1,), (9,), (9,), (None,)], "product_id long")
    u = Q.unique_violations({"products.product_code": (p, ["product_code"])}).collect()
    assert [(r.key, r.n) for r in u] == [("P-0001", 2)]
    f = Q.fk_violations({"movements.product_id": (m, "product_id", p, "id")}).collect()
    assert [(r.key, r.n) for r in f] == [("9", 2)]


def test_enum_and_column_rules(spark):
    df = spark.createDataFrame([("stock_in", "x" * 30), ("transfer", "ok")], "type string, code string")
    e = {r.value: r.in_domain for r in
         Q.enum_profile({"t": (df, "type", ["stock_in"])}).collect()}
    assert e == {"stock_in": True, "transfer": False}
    c = Q.column_rules({"t": (df, [("code_length", F.length("code") > 20)])}).collect()
    assert [(r.rule, r.violations) for r in c] == [("t.code_length", 1)]


def test_page_and_keyset_agree(spark):
    df = spark.range(0, 500).select((F.col("id") % 37).alias("ts"), F.col("id"))
    order = [F.desc("ts"), F.desc("id")]
    p2 = [(r.ts, r.id) for r in PG.page(df, order, 2, 50).collect()]
    p1_last = [(r.ts, r.id) for r in PG.page(df, order, 1, 50).collect()][-1]
    k = [(r.ts, r.id) for r in df.filter(PG.keyset_after(["ts", "id"], p1_last))
         .orderBy(*order).limit(50).collect()]
    assert p2 == k


def test_page_info_window(spark):
    t = spark.createDataFrame([("a", 0), ("b", 25), ("c", 26), ("d", 1000)], "list string, total long")
    got = {r.list: (r.pages, r.links) for r in PG.page_info(t, 3, 25).collect()}
    assert got == {"a": (0, ""), "b": (1, ""), "c": (2, "1,2"), "d": (40, "1,2,3,4,5")}


def test_any_page_of_a_stored_list_reads_its_ranges_only(spark, monkeypatch):
    import random
    import tempfile
    from stockspark.operators import page_index as PI
    monkeypatch.setattr(PI, "ROWS_PER_RANGE", 100)
    rows = [(i, i // 7) for i in range(1003)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, k long")
    paged = PI.PagedList(spark, tempfile.mkdtemp(prefix="paged-")).build(df, [F.desc("k"), F.asc("id")])
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert paged.total() == 1003
    for no, per in ((1, 25), (4, 25), (41, 25), (42, 25), (3, 400), (1, 2000)):
        got = sorted(map(tuple, paged.page(no, per).select("position", "id", "k", "total").collect()))
        assert got == [(i, *want[i], 1003) for i in range((no - 1) * per, min(no * per, 1003))]
    plan = paged.page(30, 25)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    empty = PI.PagedList(spark, tempfile.mkdtemp(prefix="paged-")).build(df.limit(0), [F.asc("id")])
    assert empty.total() == 0


def test_deletes_through_cycles_and_blocks(spark):
    from stockspark.operators.key_graph import Key, delete_through
    t = lambda rows, cols: spark.createDataFrame(rows, cols)
    tables = {"person": t([(1, None), (2, 1), (3, 2), (4, 3), (5, 5)], "id long, boss long"),
              "task": t([(10, 1, 4), (11, 4, 2), (12, 5, 5), (13, None, 1)], "id long, owner long, reviewer long"),
              "file": t([(20, 11), (21, 12), (22, 99)], "id long, task long"),
              "lock": t([(30, 20)], "id long, file long")}
    keys = [Key("person", "boss", "person", "CASCADE"), Key("task", "owner", "person", "CASCADE"),
            Key("task", "reviewer", "person", "SET NULL"), Key("file", "task", "task", "CASCADE"),
            Key("lock", "file", "file", "RESTRICT")]
    roots = {"person": t([(3,), (5,)], "id long"), "task": t([(10,)], "id long")}
    got = {(r.root_table, r.root_id, r.effect, r.target): (r.n, r.blocked)
           for r in delete_through(tables, keys, roots).collect()}
    assert got == {("person", 3, "RESTRICT", "lock.file"): (1, True),
                   ("person", 5, "CASCADE", "person"): (1, False), ("person", 5, "CASCADE", "task"): (1, False),
                   ("person", 5, "CASCADE", "file"): (1, False), ("task", 10, "CASCADE", "task"): (1, False)}
