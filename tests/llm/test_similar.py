import random
import sys
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs, words

import corpus_pipeline
from churnspark.llm import similar
from churnspark.llm.tables import table


def plain_set(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[i:i + 5]) for i in range(max(1, len(found) - 4))}


def brute_force(rows):
    """The kept (id, text), smallest id of each group, by comparing the shingles of all pairs."""
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if min(len(sets[a]), len(sets[b])) * 5 >= max(len(sets[a]), len(sets[b])) * 4:
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * len(sets[a] | sets[b]):
                group[find(b)] = find(a)
    best = {}
    for k, (i, _) in enumerate(rows):
        best.setdefault(find(k), []).append(i)
    return sorted((min((i for i in ids if i is not None), default=None) for ids in best.values()), key=str)


def kept_ids(frame):
    return sorted((r.doc_id for r in frame.collect()), key=str)


def test_edge_rows_like_brute_force(spark):
    docs = edge_docs(spark)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept_ids(kept) == brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert similar.keep_one(no_docs(spark)).collect() == []


@pytest.mark.parametrize("block, stars", [(similar.BLOCK, similar.STARS), (7, 1), (7, 0)])
def test_edited_texts_like_brute_force(spark, monkeypatch, block, stars):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "STARS", stars)
    rng = random.Random(5)
    bases = [words(rng, rng.randint(60, 400)).split() for _ in range(12)]
    rows = []
    for k in range(160):
        text = list(rng.choice(bases))
        for _ in range(rng.randint(0, len(text) // 40)):
            text[rng.randrange(len(text))] = words(rng, 1)
        rows.append((1000 - k, " ".join(text) if k % 4 else words(rng, rng.randint(1, 9))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_force(rows)
    assert kept_ids(similar.keep_one(frame)) == want and 52 < len(want) < 150


def test_rows_handed_to_groups_grow_with_the_list(spark):
    """A list of ten times the members makes about ten times the rows; no group is larger for it."""
    for n in (3_000, 30_000):
        entries = spark.range(n).select(F.lit(1).alias("key"), F.col("id").alias("node"))
        first = similar.stars(similar._open(entries, None), 0)
        assert first.count() <= n * 1.02 and first.groupBy("key", "lo", "hi").count().agg(F.max("count")).first()[0] < 2 * similar.BLOCK
        # all but 100 are connected: the others meet all of them, which need not meet each other
        parts = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") < n - 100, F.lit(0)).otherwise(F.col("id")).alias("component"))
        second = similar.across(similar._open(entries, parts))
        assert second.count() <= 2.02 * n and second.groupBy("key", "lo", "hi").count().agg(F.max("count")).first()[0] < 4 * similar.BLOCK
        assert similar._open(entries, parts.withColumn("component", F.lit(0))).isEmpty()


def test_large_group_of_near_copies(spark):
    """A third of all rows are near copies of one text; each differs from the base, few pairs from each other by less."""
    rng = random.Random(8)
    base = words(rng, 300).split()
    rows = []
    for k in range(900):
        text = list(base) if k % 3 == 0 else words(rng, 80).split()
        if k % 3 == 0:
            text[rng.randrange(300)] = words(rng, 1) + str(k)
        rows.append((k, " ".join(text)))
    assert kept_ids(similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_columns_of_any_name_stay(spark):
    frame = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "a b", 7, 8, 9)], "doc_id long, text string, __row int, row int, row_ int")
    assert [tuple(r) for r in similar.keep_one(frame).collect()] == [(1, "a b", 7, 8, 9)]


def test_pipeline_stage_like_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert kept_ids(corpus_pipeline.keep_one_of_each(spark, docs, sf)) == brute_force(rows)


def test_bound():
    assert similar.miss_probability(0.8) < 1e-4
