import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs

from churnspark.llm import boosting, quality, queries
from churnspark.llm.tables import table

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, sf):
    rows = queries.op4_quality_classifier(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count()
    truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) >= 0.95


def test_trees_step_like_a_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x, y, trees=30, depth=3)

    def walk(row):
        total = model.base
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf):
            n = 0
            while n < len(feature):
                n = 2 * n + 1 + int(row[feature[n]] > cut[n])
            total += leaf[n - len(feature)]
        return total

    assert np.allclose(model.margin(x), [walk(r) for r in x])
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_edge_rows(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(12)] + [(None, 1, 0), (3, 0, 0), (4, None, 0), (5, 7, 1)], LABELS)
    scored = quality.score(docs, labels)
    assert scored.columns == [*[c for c in docs.columns if c != "quality_score"], "quality_score"]
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r.quality_score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(r.quality_score)
    assert all(len(s) == 1 for s in by_text.values())


def test_without_labels(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], LABELS)
    assert {r.quality_score for r in quality.score(docs, none).collect()} == {0.5}
    good = spark.createDataFrame([(k, 1, 0) for k in range(12)], LABELS)
    assert len({r.quality_score for r in quality.score(docs, good).collect()}) == 1
    assert quality.score(no_docs(spark), none).collect() == []


def test_held_out_labels_do_not_matter(spark, sf):
    from pyspark.sql import functions as F

    from churnspark.llm.tables import held_out

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert (a.leaf == b.leaf).all() and (a.cut == b.cut).all()
