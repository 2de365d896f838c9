import hashlib

from pyspark.sql import functions as F

from churnspark.operators.split import class_weights, cut_keys, fold_count, holdout, mark_folds, mark_holdout, pack, split_key


def table(spark, positives, negatives):
    return spark.range(positives + negatives).select(
        F.col("id"), F.when(F.col("id") < positives, 1).otherwise(0).alias("_y")
    )


def test_published_sizes(spark):
    train, test = holdout(table(spark, 1869, 5174), "id")
    counts = {r["_y"]: r["count"] for r in test.groupBy("_y").count().collect()}
    assert counts == {0: 1035, 1: 374} and train.count() == 5634


def test_same_rows_as_ranking_by_hash(spark):
    df = table(spark, 300, 700)
    got = {r["id"] for r in mark_holdout(df, "id").where("is_test").collect()}
    want = set()
    for ids, n in ((range(300), 60), (range(300, 1000), 140)):
        want |= set(sorted(ids, key=lambda i: hashlib.md5(f"{i}-42".encode()).hexdigest())[:n])
    assert got == want


def test_repeatable_and_hash_mode(spark):
    df = table(spark, 3000, 7000)
    assert mark_holdout(df, "id", exact=False).exceptAll(mark_holdout(df.repartition(7), "id", exact=False)).count() == 0
    share = mark_holdout(df, "id", exact=False).where("is_test").count() / 10_000
    assert abs(share - 0.2) < 0.02


def test_copies_of_an_id_stay_together(spark):
    """One id holds a third of the rows: its key arrives as one counted group, never split."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("id"), (F.col("id") % 2).cast("int").alias("_y")
    )
    marked = mark_holdout(df, "id")
    per_side = marked.groupBy("id", "_y").agg(F.count_distinct("is_test").alias("sides"))
    assert per_side.where("sides > 1").count() == 0
    assert marked.where("is_test").count() <= 600


def test_folds(spark):
    df = mark_folds(table(spark, 52, 201), "id", 5)
    sizes = {(r["_y"], r["fold"]): r["count"] for r in df.groupBy("_y", "fold").count().collect()}
    for y, n in ((1, 52), (0, 201)):
        got = [sizes[(y, f)] for f in range(5)]
        assert sum(got) == n and max(got) - min(got) <= 1
    assert fold_count([3, 50]) == 3 and fold_count([1, 50]) == 2 and fold_count([70, 50]) == 5


def test_tiny_class_and_no_id(spark):
    df = table(spark, 2, 20)
    key = split_key(df, None, "42")
    assert cut_keys(df, key, "_y", [(1, 5)])[1] == [""]
    assert mark_holdout(df, None).where("is_test").count() == 4


def test_weights(spark):
    got = {r["_y"]: r["weight"] for r in class_weights(table(spark, 25, 75)).collect()}
    assert got == {1: 2.0, 0: 100 / 150}


def test_heavy_ids_are_packed(spark):
    """Three ids with 30, 18 and 12 % of the rows: each in one fold, not the same, and both classes in every fold."""
    share = F.when(F.col("n") % 50 < 15, -1).when(F.col("n") % 50 < 24, -2).when(F.col("n") % 50 < 30, -3).otherwise(F.col("n"))
    df = spark.range(5000).select(F.col("id").alias("n"), (F.col("id") % 4 == 0).cast("int").alias("_y")).withColumn("id", share).drop("n")
    marked = mark_folds(df, "id", 5)
    sizes = {(r["_y"], r["fold"]): r["count"] for r in marked.groupBy("_y", "fold").count().collect()}
    assert len(sizes) == 10 and sum(sizes.values()) == 5000
    held = {r["id"]: r["folds"] for r in marked.where("id < 0").groupBy("id").agg(F.collect_set("fold").alias("folds")).collect()}
    assert sorted(len(f) for f in held.values()) == [1, 1, 1] and len({f[0] for f in held.values()}) == 3
    # of class 0 the two larger ids hold more than the level of the rest: no row of it lies beside them
    even = [sizes[0, f] for f in range(5) if [f] not in (held[-1], held[-2])]
    assert max(even) - min(even) <= 1
    assert marked.where(F.col("fold").isin(held[-1] + held[-2]) & (F.col("id") >= 0) & (F.col("_y") == 0)).count() == 0
    assert marked.exceptAll(mark_folds(df.repartition(7), "id", 5)).count() == 0


def test_packing_of_heavy_ids_alone():
    folds, takes = pack({0: 100, 1: 20}, {"a": {0: 50, 1: 0}, "b": {0: 0, 1: 10}, "c": {0: 10, 1: 2}}, 4)
    # class 0: 40 rows beside folds of 50, 0, 10 and 0; class 1: 8 beside 0, 10, 2 and 0
    assert folds == {"a": 0, "b": 1, "c": 2} and takes == {0: [0, 17, 23], 1: [3, 3, 5]}
    assert pack({0: 8, 1: 0}, {}, 4) == ({}, {0: [2, 4, 6], 1: [0, 0, 0]})


def test_a_fold_per_id_and_nulls(spark):
    """Only heavy ids: no light rows to deal; null ids are light."""
    df = spark.range(400).select((F.col("id") % 5).alias("id"), (F.col("id") % 2).cast("int").alias("_y"))
    assert sorted(r["count"] for r in mark_folds(df, "id", 5).groupBy("fold").count().collect()) == [80] * 5
    some = df.withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    assert {r["fold"] for r in mark_folds(some, "id", 5).collect()} == set(range(5))
