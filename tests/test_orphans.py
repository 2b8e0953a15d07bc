from datetime import datetime

from quire.operators import orphans
from quire.operators.skew import carried, numbered, split_join

T = [datetime(2021, m, 1) for m in range(1, 13)]


def reference(spark, refs, targets):
    return orphans.Reference(
        "t",
        spark.createDataFrame(refs, "record_id string, k string, at timestamp, n long").select("record_id", orphans.chunk_key("k").alias("key"), "at", "n"),
        spark.createDataFrame(targets, "k string, since timestamp, until timestamp").select(orphans.chunk_key("k").alias("key"), "since", "until"),
    )


def test_kinds(spark, rows):
    r = reference(
        spark,
        [("1", "a_1", T[3], 1), ("2", " A_0001\n", T[0], 1), ("3", "a_2", T[3], 1), ("4", "b_0001", T[5], 1), ("4", "b_0001", T[5], 1), ("5", None, T[0], 1), ("6", "b_1", T[4], 1), ("7", "zz", None, 1), ("8", "a_1", None, 1)],
        [("a_0001", T[2], None), ("b_0001", T[1], T[5]), ("b_0001", T[1], T[5])],
    )
    want = [("t", "2", "late", "2021-01"), ("t", "3", "missing", "2021-04"), ("t", "4", "deleted", "2021-06"), ("t", "7", "missing", None)]
    assert rows(orphans.orphans(r, 9)) == sorted(want, key=repr)
    counts = {(x.period, x.orphan_kind): (x.n_orphans, x.n_references) for x in orphans.orphan_counts(r, 9).collect()}
    assert counts[("2021-04", "missing")] == (1, 2) and counts[(None, "missing")] == (1, 2)


def test_heavy_keys_give_the_same(spark, rows, monkeypatch):
    refs = [(str(i), "hot" if i % 3 else f"k{i % 5}", T[i % 12], 1) for i in range(300)]
    targets = [("hot", T[4], T[8]), ("k1", T[0], None)]
    light = rows(orphans.orphans(reference(spark, refs, targets), 300))
    monkeypatch.setattr(orphans, "HEAVY_LEAST", 10)
    monkeypatch.setattr(orphans, "HEAVY_KEYS", 3)
    assert rows(orphans.orphans(reference(spark, refs, targets), 300)) == light and len(light) > 100


def test_a_hot_key_in_good_order_is_not_shuffled_by_key(spark, rows, monkeypatch):
    monkeypatch.setattr(orphans, "HEAVY_LEAST", 50)
    refs = [(str(i), "hot", T[5], 1) for i in range(200)] + [("x", "lost", T[5], 1), ("y", "k1", T[5], 1)]
    r = reference(spark, refs, [("hot", T[0], None), ("k1", T[0], None)])
    got = orphans.orphans(r, 202)
    assert rows(got) == [("t", "x", "missing", "2021-06")]
    counts = [tuple(x) for x in orphans.orphan_counts(r, 202).collect()]
    assert counts == [("t", "2021-06", "missing", 1, 202)]
    # what the plan shuffles by key and month are the references less the broadcast heavy keys
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = orphans.orphans(r, 202)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    groups = orphans._groups(orphans._references(r), orphans._targets(r.targets), 202)
    heavy = {(g.key, g.heavy, g.whole, g.mixed) for g in groups.collect()}
    assert heavy == {("hot", True, None, False), ("lost", False, "missing", False), ("k1", False, None, False)}


def test_counts_of_groups_that_are_partly_orphans(spark, rows):
    refs = [("1", "a", T[2], 1), ("1", "a", T[2], 1), ("2", "a", datetime(2021, 3, 20), 1), ("3", "b", T[2], 1), ("4", "b", datetime(2021, 3, 9), 1), ("5", "c", None, 1), ("6", "a", datetime(2021, 4, 2), 1)]
    r = reference(spark, refs, [("a", datetime(2021, 3, 10), None), ("b", T[0], datetime(2021, 2, 1))])
    got = {(x.period, x.orphan_kind): (x.n_orphans, x.n_references) for x in orphans.orphan_counts(r, 7).collect()}
    assert got == {("2021-03", "late"): (1, 4), ("2021-03", "deleted"): (2, 4), (None, "missing"): (1, 1)}
    assert len(rows(orphans.orphans(r, 7))) == 4


def test_empty_tables(spark, rows):
    assert rows(orphans.orphans(reference(spark, [], []), 0)) == []
    assert rows(orphans.orphans(reference(spark, [("1", "a", T[0], 1)], []), 1)) == [("t", "1", "missing", "2021-01")]


def test_split_join_and_ordered_helpers(spark, rows, monkeypatch):
    from quire.operators import skew

    monkeypatch.setattr(skew, "HEAVY_LEAST", 3)
    a = spark.createDataFrame([("x", i) for i in range(9)] + [("y", 1), (None, 2)], "k string, v int")
    k = spark.createDataFrame([("x", 9, "X"), ("y", 1, "Y")], "k string, n long, w string")
    assert len(rows(split_join(a, k, ["k"], "n", 10))) == 10
    d = spark.createDataFrame([("d", b, i, "h" if (b, i) in ((0, 1), (2, 0)) else None) for b in range(4) for i in range(3)], "g string, b int, i int, h string")
    d = d.withColumn("h", d.h)
    got = [(r.b, r.i, r.c) for r in carried(d, "g", "b", ["i"], "h", "c").orderBy("b", "i").collect()]
    assert [c for _, _, c in got] == [None] + ["h"] * 11
    assert [r.n for r in numbered(d, "g", "b", ["i"], "n").orderBy("b", "i").collect()] == list(range(1, 13))
