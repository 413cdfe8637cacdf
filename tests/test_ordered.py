"""Bucketed windows against plain ones, with one key holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passledger.operators.ordered import exact_percentiles, neighbour, ordinal, prefix
from passledger.operators.ranges import as_of, interval_join, salted_join, without_overlap


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = [("hot" if i % 3 else f"k{i % 7}", rng.randrange(500), i, rng.uniform(-5, 5)) for i in range(900)]
    return spark.createDataFrame(data, "k string, t long, id long, v double").cache()


def test_prefix_equals_plain_window(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select(
        "id", F.row_number().over(w).alias("n"), F.max("v").over(upto).alias("m"),
        F.lag("id").over(w).alias("p"), F.lead("id").over(w).alias("q"),
    )
    bucket = F.floor(F.col("t") / 40).cast("long")
    order = ["t", "id"]
    ours = prefix(rows, ["k"], order, bucket, {"n": ("count", F.lit(1)), "m": ("max", F.col("v"))})
    ours = neighbour(ours, ["k"], order, bucket, ["id"], "a")
    ours = neighbour(ours, ["k"], order, bucket, ["id"], "b", following=True)
    ours = ours.select("id", "n", "m", F.col("a.id").alias("p"), F.col("b.id").alias("q"))
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))


def test_ordinal_does_not_depend_on_partitions(spark, rows):
    bucket = F.floor(F.col("t") / 40).cast("long")
    first = ordinal(rows, ["k"], ["t", "id"], bucket).select("id", "ordinal")
    second = ordinal(rows.repartition(13), ["k"], ["t", "id"], bucket).select("id", "ordinal")
    assert first.exceptAll(second).count() == 0


def test_hot_key_is_not_one_task(rows):
    bucket = F.floor(F.col("t") / 40).cast("long")
    plan = ordinal(rows, ["k"], ["t", "id"], bucket)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number" in line or "count(1) windowspec" in line]
    groups = [line for line in plan.splitlines() if "AS _group" in line]
    assert windows and all("_group" in line for line in windows) and all("_bucket" in line for line in groups)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentiles_are_exact(rows, p):
    got = {r.k: r.x for r in exact_percentiles(rows, ["k"], "v", {"x": p}).collect()}
    pdf = rows.toPandas()
    for k, group in pdf.groupby("k"):
        assert got[k] == pytest.approx(np.quantile(group["v"], p), abs=1e-12)


def test_percentiles_with_equal_and_infinite_values(spark):
    data = [("a", 1.0)] * 50 + [("a", 2.0)] * 50 + [("b", float("inf")), ("b", 1.0), ("b", float("inf"))]
    data += [("c", None)]
    frame = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r.m for r in exact_percentiles(frame, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 1.5, "b": float("inf")}


def test_overlap_and_as_of_against_brute_force(spark):
    rng = random.Random(5)
    bookings = [(i % 3, s, s + rng.randrange(1, 30)) for i in range(60) for s in [rng.randrange(900)]]
    asked = [(i, i % 3, s, s + rng.randrange(1, 20)) for i in range(80) for s in [rng.randrange(900)]]
    b = spark.createDataFrame(bookings, "a int, s long, e long")
    c = spark.createDataFrame(asked, "id int, a int, s0 long, e0 long")
    free = without_overlap(c, b, ["a"], "s0", "e0", booked_start="s", booked_stop="e", width=100)
    want = {i for i, a, s, e in asked if not any(x == a and s < z and y < e for x, y, z in bookings)}
    assert {r.id for r in free.collect()} == want

    history = b.select("a", F.col("s").alias("known"))
    found = as_of(c, history, ["a"], "s0", "known", ["known"], width=100)
    for r in found.collect():
        past = [s for a, s, _ in bookings if a == r.a and s <= r.s0]
        assert (r.latest.known if r.latest else None) == (max(past) if past else None)


def test_touching_intervals_do_not_overlap(spark):
    b = spark.createDataFrame([(1, 10, 20)], "a int, s long, e long")
    c = spark.createDataFrame([(1, 1, 0, 10), (2, 1, 20, 30), (3, 1, 19, 20)], "id int, a int, s0 long, e0 long")
    free = without_overlap(c, b, ["a"], "s0", "e0", booked_start="s", booked_stop="e", width=7)
    assert {r.id for r in free.collect()} == {1, 2}


def test_interval_join_is_a_hashed_join(spark, rows):
    windows = spark.createDataFrame([("hot", 100, 220, 1), ("k0", 0, 499, 2)], "k string, a long, z long, w int")
    joined = interval_join(rows, windows, ["k"], "t", "a", "z", width=50, salts=3)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = rows.where("k = 'hot' AND t BETWEEN 100 AND 220 OR k = 'k0'").count()
    assert joined.count() == want


def test_salted_join_keeps_rows(spark, rows):
    names = rows.select("k").distinct().withColumn("name", F.upper("k"))
    joined = salted_join(rows, names, ["k"], F.col("id"), salts=5)
    assert joined.count() == 900 and joined.where("name <> upper(k)").count() == 0


def test_null_keys_and_orders_stay(spark):
    rows = spark.createDataFrame(
        [(None, 5, 1), (None, None, 2), ("a", None, 3), ("a", 90, 4), ("a", 10, 5), (None, 100, 6)], "k string, t long, id long"
    )
    bucket = F.floor(F.col("t") / 40).cast("long")
    for down in (False, True):
        order = [F.col(c).desc() if down else F.col(c).asc() for c in ("t", "id")]
        w = Window.partitionBy("k").orderBy(*order)
        plain = rows.select("id", F.row_number().over(w).alias("n"), F.lag("id").over(w).alias("p"))
        ours = ordinal(rows, ["k"], ["t", "id"], bucket, "n", descending=down)
        ours = prefix(ours, ["k"], ["t", "id"], bucket, {"p": ("last", F.col("id"))}, inclusive=False, descending=down)
        assert sorted(map(tuple, ours.select("id", "n", "p").collect())) == sorted(map(tuple, plain.collect()))


def test_percentiles_with_null_groups_and_nan(spark):
    nan = float("nan")
    data = [(None, v) for v in (1.0, 2.0, 4.0)] + [("a", v) for v in (2.0, 5.0, nan)] + [("b", nan), ("b", None)]
    frame = spark.createDataFrame(data, "g string, v double")
    got = {r.g: r.m for r in exact_percentiles(frame, ["g"], "v", {"m": 0.5}).collect()}
    assert got[None] == 2.0 and got["a"] == 5.0 and np.isnan(got["b"])


def test_accepted_folds_without_a_number_are_unscored(spark):
    from passledger.operators.study import qualification

    data = [("k", v) for v in (float("nan"), 1.0, 2.0)] + [("i", float("inf")), ("f", 2.0)]
    folds = spark.createDataFrame(data, "k string, position_rmse_km double").selectExpr("*", "true success", "true accepted", "'complete' coverage")
    got = {r.k: (r.status, r.median_km) for r in qualification(folds, ["k"]).collect()}
    assert got == {"k": ("unscored", None), "i": ("unscored", None), "f": ("available", 2.0)}


def test_percentiles_hold_no_whole_split(spark):
    # what a task holds is its share of a shuffle: rows are dealt out, once for all uses, before any is counted
    made = spark.range(4000, numPartitions=3).selectExpr("id % 5 AS k", "id * 0.37D AS v")
    found = exact_percentiles(made, ["k"], "v", {"m": 0.5})
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    leaves = [i for i, line in enumerate(lines) if "Range (" in line]
    assert leaves
    for leaf in leaves:
        above, at = [], depth[leaf]
        for i in range(leaf, -1, -1):
            if i == leaf or depth[i] < at:
                above.append(lines[i])
                at = depth[i]
        dealt = next(i for i, line in enumerate(above) if "RepartitionByExpression" in line)
        assert not any("Aggregate" in line or "Window" in line for line in above[:dealt])
    found.collect()
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_percentiles_of_one_frequent_value(spark):
    # the frequent value has rows in every part of the input, so in every salt, beside others of its band
    rng = random.Random(11)
    values = [2.0] * 700 + [2.0 + 1e-9 * i for i in range(60)] + [rng.uniform(-9, 9) for _ in range(800)] + [-0.0, 0.0, float("-inf"), 1e305]
    rng.shuffle(values)
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(13).selectExpr("'hot' AS k", "v").unionByName(
        spark.createDataFrame([("one", 4.0)], "k string, v double")
    )
    fractions = {f"p{i}": i / 16 for i in range(17)}
    got = {r.k: r.asDict() for r in exact_percentiles(frame, ["k"], "v", fractions).collect()}
    assert all(got["one"][name] == 4.0 for name in fractions)
    ordered = sorted(values)
    for name, p in fractions.items():
        at = (len(ordered) - 1) * p
        low, high = ordered[int(at)], ordered[int(np.ceil(at))]
        want = low if at == int(at) or low == high else low + (high - low) * (at - int(at))
        assert got["hot"][name] == want
