import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from frames import no_docs, words
from test_decontaminate import exhaustive
from test_similar import brute_force

import __spark_entry__ as registry
import corpus_pipeline
import public_tokenizers
from churnspark.llm import quality, queries, secrets
from churnspark.llm.tables import table
from tokenizers import Tokenizer


def test_rows_like_the_stages_by_brute_force(spark, sf):
    """Quality by the trees on each text, the five-word shingles of all pairs, all passages against all items."""
    docs = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    trees = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    left = {d: t for d, t in docs.items() if trees.score(quality.np.array([quality.statistics(t)]))[0] >= quality.REJECT_BELOW}
    left = {d: left[d] for d in brute_force(sorted(left.items()))}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    leaky = {d for d, _ in exhaustive(left.items(), items)}
    left = {d: t for d, t in left.items() if d not in leaky}
    frame = spark.createDataFrame(sorted(left.items()), "doc_id long, text string")
    left = {r.doc_id: r.text for r in secrets.redact(secrets.scan(frame), mark="[secret]").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in left.items()}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "BPE encoding"]
    rng = random.Random(1)
    rows = [(k, words(rng, 60), "en", "s", 1) for k in range(30)]
    rows += [(100, rows[0][1], "en", None, None), (101, None, None, None, None), (None, rows[1][1], "en", "s", 1), rows[2], (102, "", "de", "s", 0)]
    rows += [(103, "password = 'hunter2222' " + words(rng, 40), "en", "s", 64)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).withColumn("a.b", queries.F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[5][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    # without labels every score is 0.5 and all would go; the others are tried on what is there
    assert corpus_pipeline.keep_quality(spark, docs, str(tmp_path)).collect() == []
    kept = corpus_pipeline.keep_one_of_each(spark, docs, str(tmp_path))
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 100 not in ids and None not in ids and 2 in ids and len({101, 102} & set(ids)) == 1
    clean = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {5}
    assert clean.count() == docs.count() - 1
    redacted = {r.doc_id: r for r in corpus_pipeline.redact_secrets(spark, docs, str(tmp_path)).collect()}
    assert redacted[103].text.startswith("[secret]' ") and redacted[103].n_chars == len(redacted[103].text)
    assert redacted[101].text is None and redacted[4].text == rows[4][1]
    names = ["quality_score", "leaks", "Blob", "findings", "fp", "node", "row", "__row", "ids_"]
    clashing = docs.withColumns({n: queries.F.lit(n) for n in names})
    for _, f in corpus_pipeline.STAGES[:-1]:
        back = f(spark, clashing, str(tmp_path))
        assert back.columns == clashing.columns and all(r[n] == n for r in back.select(*names).collect() for n in names)
        assert f(spark, docs, str(tmp_path)).columns == docs.columns
        assert f(spark, no_docs(spark), str(tmp_path)).collect() == []


def test_registered():
    names = set(registry.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert "op5_secret_scans" in registry.oracle_sql()
