"""Plans for hot groups, against brute force."""

import random
import statistics
from collections import defaultdict

from pyspark.sql import functions as F

from cutline.plans.pooled import first_per_key, lookup, numbered, pooled_medians, with_medians


def test_medians_of_hot_and_small_groups(spark):
    rnd = random.Random(5)
    rows = [("hot", rnd.choice([rnd.uniform(-3, 3), float(rnd.randint(-90000, 90000)), 7.0])) for _ in range(4001)]
    rows += [(f"g{i % 50}", rnd.uniform(-1, 1)) for i in range(999)] + [(None, 1.0), (None, 4.0), ("void", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    groups = defaultdict(list)
    for k, v in rows:
        if v is not None:
            groups[k].append(v)
    found = {r.k: r for r in pooled_medians(df, ["k"], {"m": "v", "a": "abs(v)"}).collect()}
    assert set(found) == set(groups)
    for k, vs in groups.items():
        assert found[k].m == statistics.median(vs)
        assert found[k].a == statistics.median(map(abs, vs))


def test_aggregates_stay_without_any_value(spark):
    df = spark.createDataFrame([("x", None), ("y", 2.0)], "k string, v double")
    rows = {r.k: r for r in with_medians(df, ["k"], ["count(1) AS n"], {"m": "v"}).collect()}
    assert rows["x"].n == 1 and rows["x"].m is None and rows["y"].m == 2.0


def test_first_per_key_counts_only_eligible_rows(spark):
    rows = [(1, "a", False), (2, "a", True), (3, "a", True), (4, None, True), (5, None, True), (6, "b", True)]
    df = spark.createDataFrame(rows, "id int, k string, ok boolean")
    found = {r.id for r in first_per_key(df, ["k"], "id", "ok").filter("is_first").collect()}
    assert found == {2, 4, 6}


def test_first_per_key_with_ids_that_restart(spark):
    rows = [("d1", 0, "a"), ("d1", 1, "a"), ("d2", 0, "b"), ("d2", 1, "a"), ("d2", 2, "b"), (None, 0, "a"), (None, 1, "a")]
    df = spark.createDataFrame(rows, "doc string, id int, k string")
    found = first_per_key(df, ["doc", "k"], "id", scope=["doc"])
    assert found.count() == len(rows)
    kept = sorted((r.doc or "-", r.id) for r in found.filter("is_first").collect())
    assert kept == [("-", 0), ("d1", 0), ("d2", 0), ("d2", 1)]


def test_numbering_across_spans(spark):
    ids = random.Random(1).sample(range(5000), 900)
    df = spark.createDataFrame([(i % 3 % 2, i) for i in ids], "g int, id int")
    found = {(r.g, r.id): r.n for r in numbered(df, ["g"], "id", "n", span=100).collect()}
    for g in (0, 1):
        mine = sorted(i for i in ids if i % 3 % 2 == g)
        assert [found[(g, i)] for i in mine] == list(range(1, len(mine) + 1))


def _settings(spark, values):
    old = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)
    return old


def test_lookup_splits_a_hot_key(spark):
    """The table is an aggregate by the same key, and the join is still split."""
    old = _settings(
        spark,
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        },
    )
    try:
        rows = spark.range(0, 400000, numPartitions=16).select(
            F.expr("CASE WHEN id % 3 = 0 THEN 0 ELSE id % 5000 END AS k"), F.expr("sha2(string(id), 256) AS load")
        )
        table = rows.groupBy("k").agg(F.expr("count(1) AS n"))
        joined = lookup(rows, table, ["k"])
        joined.write.format("noop").mode("overwrite").save()
        total = joined.agg(F.expr("sum(IF(k = 0, 1, 0)) AS hot"), F.expr("count(n) AS rows")).first()
        assert total.rows == 400000 and total.hot > 400000 / 3
        check = lookup(rows, table, ["k"])
        check.collect()
        assert "skew=true" in check._jdf.queryExecution().executedPlan().toString()
    finally:
        _settings(spark, old)


def test_lookup_of_missing_and_null_keys(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    table = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    assert sorted((r.k or 0, r.v or "-") for r in lookup(rows, table, ["k"]).collect()) == [(0, "-"), (1, "x"), (2, "-")]
    assert [r.v for r in lookup(rows, table, ["k"], "inner").collect()] == ["x"]
