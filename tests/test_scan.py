"""Segmented scans against plain loops: keys that span many ranges, null keys, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from lorebase.operators.scan import Running, numbered, scan

KIND = "source string, at long, label string, other string"


def plain(rows):
    out, by = {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append(r)
    for own in by.values():
        for k, (s, at, label, _) in enumerate(own):
            before = [x[2] for x in own[: k + 1] if x[2] is not None]
            behind = [x[2] for x in own[k:] if x[2] is not None]
            out[at] = (k + 1, sum(x[2] is not None for x in own[: k + 1]), before[-1] if before else None, behind[0] if behind else None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_scan(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), k, rng.choice([None] * 9 + ["x", "y"]), "o") for k in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, KIND)
    running = {"n": Running("sum", F.lit(1)), "n_labels": Running("sum", F.col("label").isNotNull().cast("int")), "prev": Running("previous", F.col("label")), "next": Running("next", F.col("label"))}
    got = scan(df, ["source"], ["at"], running, 13)
    assert got.columns == [*df.columns, "n", "n_labels", "prev", "next"]
    assert {r.at: (r.n, r.n_labels, r.prev, r.next) for r in got.collect()} == plain(rows)


def test_numbers(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS part", "id AS k")
    assert sorted((r.id, r.place) for r in numbered(df, [], ["id"], "place", 7).collect()) == [(k, k + 1) for k in range(500)]
    got = numbered(df.drop("k"), ["part"], ["id"], ranges=7).collect()
    assert all(r.k == r.id // 3 + 1 for r in got) and len(got) == 500
    assert numbered(df.limit(0), ["part"], ["id"], "place").collect() == []


def test_hot_key_in_many_tasks(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("source"), "id")
    found = numbered(df, ["source"], ["id"], ranges=10)
    assert found.where("source = 'hot'").agg(F.max("k")).first()[0] == 900
    tasks = df.repartitionByRange(10, "source", "id").withColumn("t", F.spark_partition_id()).where("source = 'hot'").select("t").distinct().count()
    assert tasks >= 8
