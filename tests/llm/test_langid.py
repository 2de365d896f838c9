import sys
import zlib
from itertools import product
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs

from churnspark.llm import langid, queries
from churnspark.llm.tables import table


def test_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    rows = queries.op6_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]) >= 0.95


@pytest.mark.parametrize("sizes", [[1], [3, 1, 5], [4, 4]])
def test_marginals_like_all_paths(sizes):
    rng = np.random.default_rng(len(sizes))
    model = langid.Field(["a", "b", "c"], np.zeros((1, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3))
    emissions = rng.standard_normal((sum(sizes), 3))
    want, at = np.zeros_like(emissions), 0
    for n in sizes:
        for path in product(range(3), repeat=n):
            score = model.first[path[0]] + sum(emissions[at + t, c] for t, c in enumerate(path))
            score += sum(model.changes[a, b] for a, b in zip(path, path[1:]))
            for t, c in enumerate(path):
                want[at + t, c] += np.exp(score)
        at += n
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(model.marginals(emissions, np.array(sizes)), want)
    assert np.allclose(langid.forward_backward(emissions, np.array(sizes), model.changes, model.first)[0], want)


def test_segments_put_together_exactly():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 64, 65, 1000, 7, 128, 129])
    model = langid.Field(list("abcd"), np.zeros((1, 4)), rng.standard_normal((4, 4)) * 2, rng.standard_normal(4))
    emissions = rng.standard_normal((sizes.sum(), 4)) * 3
    assert np.allclose(model.marginals(emissions, sizes), langid.forward_backward(emissions, sizes, model.changes, model.first)[0])


def test_code_switching(spark, sf):
    model = langid.train(table(spark, sf, "documents"))
    (words, chances), = langid.label_words(model, ["The thing is that. Nicht der und die mit. Les eaux dans elle"])
    got = [model.languages[k] for k in chances.argmax(axis=1)]
    assert got[:4] == ["en"] * 4 and got[4:9] == ["de"] * 5 and got[10:] == ["fr"] * (len(words) - 10)


def test_edge_rows(spark, sf):
    model = langid.train(table(spark, sf, "documents"))
    docs = edge_docs(spark)
    found = langid.predict(docs, model)
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.lang_score == 0)
        assert r.lang_pred == "und" or r.lang_pred in model.languages
    assert langid.predict(no_docs(spark), model).collect() == []


def test_nothing_to_learn_from(spark):
    model = langid.train(no_docs(spark))
    assert {r.lang_pred for r in langid.predict(edge_docs(spark), model).collect()} == {"und"}
    one = langid.train(edge_docs(spark).where("lang = 'en'"))
    assert {r.lang_pred for r in langid.predict(edge_docs(spark), one).collect()} == {"und", "en"}


def test_numerals_are_no_letters_and_marks_stay_on_theirs(spark, sf):
    assert langid.words_of("½ ² ٣ Ⅷ 12 _") == [] and langid.words_of("हिन्दी É1é Ab_c") == ["हिन्दी", "é", "é", "ab", "c"]
    docs = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ ٣"), (3, ""), (4, "plain words")], "doc_id long, text string")
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    found = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(docs, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] != "und"
