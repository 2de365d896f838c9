import random
import sys
from itertools import combinations
from pathlib import Path

import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs, words

from churnspark.llm import simhash


def plain_fingerprint(text):
    """Bit by bit from the definition."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    found = [w for w in lowered.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i:i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_force(rows):
    """{row number: component} by comparing all pairs."""
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            group[find(b)] = find(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, fps[k], least.get(find(k))) for k, (i, _) in enumerate(rows)]


def test_every_four_positions_contain_a_key():
    keys = [set(k) for k in simhash.index_positions()]
    assert len(keys) == 20
    assert all(any(k <= set(four) for k in keys) for four in combinations(range(8), 4))


@pytest.mark.parametrize("text", [
    None, "", " \t", "one", "One two THREE", "É a\x0bb\x0cc d e", "x\x85y\xa0z a b c", "a b c d " * 50, words(random.Random(1), 3000)])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def as_tuples(frame):
    return sorted(((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in frame.collect()), key=str)


def test_edge_rows_like_brute_force(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert as_tuples(simhash.near_duplicates(docs)) == sorted(brute_force(rows), key=str)


def test_near_copies_like_brute_force(spark):
    rng = random.Random(2)
    base = words(rng, 300).split()
    rows = []
    for k in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = words(rng, 1)
        rows.append((1000 - k, " ".join(text) if k % 3 else words(rng, rng.randint(1, 40))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = as_tuples(simhash.near_duplicates(frame))
    assert got == sorted(brute_force(rows), key=str)
    assert len({c for _, _, c in got}) < len(got)


def test_lists_longer_than_a_block(spark, monkeypatch):
    from churnspark.llm import postings

    monkeypatch.setattr(postings.crowded, "__defaults__", (7,))
    rng = random.Random(3)
    centre = rng.getrandbits(62)
    fps = list({centre ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 5))) for _ in range(120)})
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    assert all((r.a ^ r.b).bit_count() <= 4 for r in edges)
    group = {f: f for f in fps}

    def find(f):
        while group[f] != f:
            f = group[f]
        return f

    for r in edges:
        group[find(r.a)] = find(r.b)
    assert all(find(a) == find(b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4)


def test_empty_table(spark):
    assert simhash.near_duplicates(no_docs(spark)).collect() == []
    assert simhash.keep_one(no_docs(spark)).collect() == []


def test_keep_one_keeps_one_row_of_each_group(spark):
    docs = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    names = {c for _, _, c in brute_force(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(names)
