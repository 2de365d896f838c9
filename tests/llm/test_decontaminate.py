import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs, words

from churnspark.llm import decontaminate, queries
from churnspark.llm.tables import table

ITEMS = "item_id long, text string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not row else row
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def exhaustive(texts, items, threshold=decontaminate.THRESHOLD, overlap=decontaminate.OVERLAP):
    """All passages scored against all items by the textbook formula."""
    import math
    from collections import Counter

    split = [(k, decontaminate.words_of(t), *decontaminate.question_and_answer(t)) for k, t in items if decontaminate.words_of(t)]
    n, mean = len(split), sum(len(w) for _, w, _, _ in split) / max(1, len(split))
    df = Counter(w for _, ws, _, _ in split for w in set(ws))

    def weight(w, ws):
        tf = ws.count(w)
        return math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))

    hits = set()
    for d, t in texts:
        ws = decontaminate.words_of(t)
        for k, iw, question, answer in split:
            size = 64
            while size < len(iw):
                size *= 2
            full = sum(weight(w, iw) for w in set(iw))
            for first in range(0, max(1, len(ws)), size):
                passage = ws[first:first + 2 * size]
                score = sum(weight(w, iw) for w in set(iw) & set(passage)) / full
                if score >= threshold - 1e-9 and min(lcs(question, passage) / len(question), lcs(answer, passage) / len(answer)) >= overlap:
                    hits.add((d, k))
    return hits


def found(frame):
    return {(r.doc_id, x.item_id) for r in frame.collect() for x in r.leaks}


def make(seed):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randint(6, 150)) + rng.choice([". ", "\n", " "]) + words(rng, rng.randint(1, 12)) + ".") for k in range(40)]
    items += [(40, items[0][1]), (41, "word"), (42, ""), (43, None), (44, "?!")]
    docs = []
    for d in range(60):
        parts = [words(rng, rng.randint(0, 300))]
        for k in rng.sample(range(40), rng.randint(0, 2)):
            leak = items[k][1].split()
            for _ in range(rng.choice([0, 0, 1, 4, 30])):
                leak[rng.randrange(len(leak))] = words(rng, 1)
            parts += [" ".join(leak).upper() if rng.random() < 0.3 else "  ".join(leak), words(rng, rng.randint(0, 300))]
        docs.append((d, " ".join(parts)))
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_like_exhaustive_search(spark, seed):
    docs, items = make(seed)
    got = found(decontaminate.find_leaks(spark.createDataFrame(docs, ITEMS.replace("item", "doc")), spark.createDataFrame(items, ITEMS)))
    assert got == exhaustive(docs, items) and len(got) > 20


def test_several_indexes_find_the_same(spark):
    docs, items = make(3)
    frame, tests = spark.createDataFrame(docs, ITEMS.replace("item", "doc")), spark.createDataFrame(items, ITEMS)
    assert found(decontaminate.find_leaks(frame, tests, index_words=700)) == found(decontaminate.find_leaks(frame, tests))


def test_ordered_overlap_like_the_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 70))] for _ in range(2))
        assert decontaminate.in_order(a, b) == pytest.approx(lcs(a, b) / len(a))


def test_query_finds_every_verbatim_item(spark, sf):
    got = {(r.doc_id, r.item_id) for r in queries.op3_benchmark_decontamination(spark, sf).collect()}
    items = [(r.item_id, re.sub(r"\s+", " ", r.text)) for r in table(spark, sf, "benchmark").collect()]
    texts = [(r.doc_id, re.sub(r"\s+", " ", r.text)) for r in table(spark, sf, "documents").collect()]
    assert {(d, k) for d, t in texts for k, i in items if i in t} <= got
    assert got == exhaustive([t for t in texts if t[0] in {d for d, _ in got} or t[0] < 30], items)


def test_edge_rows(spark):
    docs = edge_docs(spark)
    items = spark.createDataFrame([(None, docs.first().text), (1, None), (2, ""), (3, "lorem ipsum dolor")], ITEMS)
    out = decontaminate.find_leaks(docs, items)
    assert out.count() == docs.count() and set(out.columns) == set(docs.columns)
    assert (0, None) in found(out) and (23, 3) in found(out)
    empty = spark.createDataFrame([], ITEMS)
    assert found(decontaminate.find_leaks(docs, empty)) == set()
    assert decontaminate.find_leaks(no_docs(spark), items).collect() == []
