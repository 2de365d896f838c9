import random
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from churnspark.llm import piece, queries, words
from frames import LONG, edge_docs

PATH = queries.PIECES
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = piece.Encoder(piece.Model.read(PATH))
ODD = " ▁\n\tab<0x0A></s><unk>éß中文字の한글😀नमस्ते́\x00\x7f=-.…'01eE‍﻿"


def one(text):
    ids, _ = ENCODER.encode([text])
    return ids.tolist()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet=ODD, max_size=40), st.text(max_size=30), st.lists(st.sampled_from(ENCODER.model.texts[259:]), max_size=8).map("".join)))
def test_ids_and_texts_equal_the_library(text):
    assert one(text) == LIBRARY.encode(text)
    assert ENCODER.decode(one(text)) == LIBRARY.decode(LIBRARY.encode(text))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 262), st.sampled_from([29871, 300, 400, 31999])), max_size=9))
def test_any_ids_decode_as_in_the_library(ids):
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", [" " * 5001, "=" * 5000, "ab" * 5000, "中" * 999, "x" * 3 + " " * 17 + "y", LONG])
def test_long_texts(text):
    assert one(text) == LIBRARY.encode(text)


def test_backtracking_equals_exact_merging_of_whole_words():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice("▁aeioustrnlh") for _ in range(rng.randint(1, 60)))
        assert ENCODER.known(text) == ENCODER.model.merge(text)


def test_a_full_memory_starts_afresh():
    small = words.Memory(lambda new: [ENCODER.word(w) for w in new], words=3)
    for text in ("a b c d", "e f g h", "a b c d"):
        ids, _ = small.encode([ENCODER.words(text)])
        assert ids.tolist() == LIBRARY.encode(text)
    assert len(small.number) == 4


def test_frames_with_everything(spark):
    docs = edge_docs(spark).withColumnRenamed("lang", "ids")
    coded = piece.encode(docs, PATH, decoded="decoded")
    assert set(coded.columns) == {*docs.columns, "decoded"} and coded.count() == docs.count()
    again = piece.decode(coded.drop("decoded"), PATH)
    for r in again.join(coded.select("ids", F.col("decoded").alias("first")), "ids").collect():
        assert r.ids == LIBRARY.encode(r.text or "") and r.decoded == r.first == LIBRARY.decode(r.ids)
    assert piece.encode(docs.limit(0), PATH).count() == 0
    nothing = piece.decode(spark.createDataFrame([(None,)], "ids array<int>"), PATH).collect()
    assert nothing[0].decoded is None


def test_a_file_of_another_kind_is_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"\x0a\x05\x0a\x01a\x18\x01")
    with pytest.raises(ValueError):
        piece.Model.read(str(tmp_path / "m"))


def test_query_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op12_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(LIBRARY.decode(ids).encode()).hexdigest()
    assert np.mean([r.n_tokens for r in rows]) > 10
