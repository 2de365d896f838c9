import sys
from collections import Counter
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs

from churnspark.llm import queries, sharding


def test_exact_sizes_and_slots(spark):
    for n in (0, 1, 23, 24, 25, 1000):
        rows = sharding.shuffle_into_shards(spark.range(n).toDF("doc_id")).collect()
        assert sorted(r.doc_id for r in rows) == list(range(n))
        counts = Counter(r.shard for r in rows)
        assert max(counts.values(), default=0) - min([counts[s] for s in range(24)]) <= 1
        for s, c in counts.items():
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(c))


def test_edge_rows(spark, tmp_path):
    docs = edge_docs(spark)
    placed = sharding.shuffle_into_shards(docs)
    assert placed.count() == docs.count()
    assert set(placed.columns) == set(docs.columns)
    assert sharding.shuffle_into_shards(no_docs(spark)).collect() == []


def test_query_columns(spark, tmp_path):
    import zlib

    edge_docs(spark, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    texts = Counter(((r.text or "").encode() for r in edge_docs(spark).collect()))
    rows = queries.op8_sharding(spark, str(tmp_path)).collect()
    assert Counter((r.size, r.text_crc32) for r in rows) == Counter({(len(t) + 8, zlib.crc32(t)): 0 for t in texts}) + Counter(
        (len(t) + 8, zlib.crc32(t)) for t in texts.elements())
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_matrix_has_the_margins():
    blocks = [7, 0, 100, 31, 62]
    room = sharding.capacities(200)
    m = sharding.matrix(blocks, room)
    assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == room and (m >= 0).all()


def test_draw_is_hypergeometric():
    rng = np.random.default_rng(1)
    good, bad, picks = 9, 14, 8
    mine = np.bincount([sharding.draw(rng, good, bad, picks) for _ in range(20000)], minlength=9) / 20000
    theirs = np.bincount(rng.hypergeometric(good, bad, picks, 200000), minlength=9) / 200000
    assert np.abs(mine - theirs).max() < 0.02
    large = [sharding.draw(rng, 2 * 10**9, 45 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(large) - 10**6 * 2 / 47) < 60 and 150 < np.std(large) < 260


def test_the_order_is_mixed_and_repeatable(spark):
    first = sharding.shuffle_into_shards(spark.range(4800).toDF("doc_id")).collect()
    again = sharding.shuffle_into_shards(spark.range(4800).toDF("doc_id")).collect()
    assert {tuple(r) for r in first} == {tuple(r) for r in again}
    low = Counter(r.shard for r in first if r.doc_id < 2400)
    assert all(60 < low[s] < 140 for s in range(24))
    slots = [r.slot for r in first if r.doc_id < 2400]
    assert 90 < np.mean(slots) < 110
