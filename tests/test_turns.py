"""Taking in turn and coverage against plain loops."""

import random

from plumbline.operators import keys, matching


def slow_turns(items, links):
    out = set()
    for g in {g for g, _ in items}:
        used = set()
        for i in sorted(i for h, i in items if h == g):
            free = sorted({c for h, j, c in links if (h, j) == (g, i) and c is not None} - used)
            out.add((g, i, ["missing", "taken", "ambiguous"][min(len(free), 2)], free[0] if len(free) == 1 else None))
            used |= set(free) if len(free) == 1 else set()
    return out


def test_turns(spark):
    rng = random.Random(9)
    items = [(f"g{g}", i) for g in range(30) for i in range(rng.randint(0, 14))] + [("chain", i) for i in range(9)]
    links = [(g, i, rng.choice([None, *range(12)])) for g, i in items if g != "chain" for _ in range(rng.choice([0, 1, 1, 2, 3]))]
    links += [("chain", i, i + k) for i in range(9) for k in (0, 1)] + [("chain", 0, 0), ("chain", 8, 0), ("other", 1, 1), ("chain", 99, 4)]
    args = spark.createDataFrame(items, "g string, i int"), spark.createDataFrame(links, "g string, i int, c int").selectExpr("*", "1 AS state", "2 AS __n")
    got = [tuple(r) for r in matching.take_in_turn(*args, "g", "i", "c").collect()]
    assert len(got) == len(items) and set(got) == slow_turns(items, links)
    assert {r["state"] for r in matching.take_in_turn(args[0], args[1].limit(0), "g", "i", "c").collect()} == {"missing"}
    assert matching.take_in_turn(args[0].limit(0), args[1], "g", "i", "c").count() == 0


def test_coverage(spark):
    features = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (4, "z"), (None, "a")], "s int, f string")
    rules = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "y"), (None, "all")], "f string, i string")
    asked = keys.required(features, rules, "s", "f", "i")
    assert {tuple(r) for r in asked.collect()} == {(1, "x"), (1, "y"), (1, "all"), (2, "y"), (2, "all"), (3, "all"), (4, "all"), (None, "x"), (None, "y"), (None, "all")}
    given = spark.createDataFrame([(1, "x"), (1, "x"), (1, "q"), (2, "all"), (2, "y"), (5, "x"), (3, None), (None, "x")], "s int, i string")
    got = {r["s"]: (r["n_asked"], r["n_given"], r["missing"], r["surplus"], r["complete"]) for r in keys.coverage(asked, given, "s", "i").collect()}
    assert got == {1: (3, 1, ["all", "y"], ["q"], False), 2: (2, 2, [], [], True), 3: (1, 0, ["all"], [], False), 4: (1, 0, ["all"], [], False)}
    assert keys.required(features, rules.limit(0), "s", "f", "i").count() == 0
    assert keys.coverage(asked.limit(0), given, "s", "i").count() == 0


def test_subjects_are_not_dealt_by_feature(spark):
    features = lambda n: spark.range(n).selectExpr("id AS s", "'a' AS f")
    rules = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "all")], "f string, i string")
    plan = keys.required(features(10**8), rules, "s", "f", "i")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan  # it would have one partition a feature
    whole = keys.required(features(1000), rules, "s", "f", "i", broadcast_rules=2, partitions=5)
    assert {tuple(r) for r in keys.required(features(1000), rules, "s", "f", "i").collect()} == {tuple(r) for r in whole.collect()} == {(s, i) for s in range(1000) for i in ("x", "y", "all")}
    # dealt once: both groupings use the shares that the subjects were dealt to
    dealt = keys.coverage(whole, whole, "s", "i", partitions=7)
    assert dealt.where("complete AND n_given = 3").count() == 1000 and dealt.rdd.getNumPartitions() == 7
