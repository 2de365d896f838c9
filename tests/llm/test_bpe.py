import hashlib
import random
import sys
import unicodedata
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs

from churnspark.llm import bpe, queries
from churnspark.llm.tables import table

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.read(PATH))


def lists(encoder, texts):
    ids, bounds = encoder.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def random_texts(seed, n):
    rng = random.Random(seed)
    near = "aaabbcdetthhein'' s't're0123½²!?.,-ßÄÖÜéΣσςİıſK \t\n\x1c\x85\xa0​　中文한글🙂👍Å<|>startoftext"
    far = [c for c in map(chr, range(1, 0x1FFFF)) if unicodedata.category(c) not in ("Cn", "Cs")]
    for _ in range(n):
        yield "".join(rng.choice(near) for _ in range(rng.randint(0, 60)))
        yield "".join(rng.choice(far) for _ in range(20))
        yield " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 15))) for _ in range(10))


def test_like_the_library(encoder, library):
    texts = list(random_texts(1, 2000)) + [
        "", "   ", "<|startoftext|>", " <|endoftext|>x", "a<|startoftext|><|endoftext|>b", "a" * 3000, "=" * 3000, "the</w>", "ΑΣ ΑΣΣ", "<|STARTOFTEXT|>"]
    assert lists(encoder, texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_speculation_is_checked_and_mended(encoder):
    vocabulary = encoder.vocabulary
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 12))) for _ in range(3000)]
    right = vocabulary.encode_words(words)
    proposed = [vocabulary.propose(w) for w in words]
    wrong = sum(p != r for p, r in zip(proposed, right))
    assert 0 < wrong < len(words)
    for p, r in zip(proposed, right):  # the check of the borders tells exactly the wrong ones
        stands = vocabulary.stands(np.array(p[:-1], int), np.array(p[1:], int)).all()
        assert stands == (p == r)


def test_long_words_by_heap_like_short_ones(encoder, monkeypatch):
    words = ["".join(random.Random(k).choice("etaoin") for _ in range(30)) for k in range(200)]
    by_scan = [encoder.vocabulary.merge(w) for w in words]
    monkeypatch.setattr(bpe, "_SHORT", 0)
    assert [encoder.vocabulary.merge(w) for w in words] == by_scan


def test_memory_starts_afresh(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    small = bpe.Encoder(bpe.Vocabulary.read(PATH))
    texts = list(random_texts(2, 50))
    assert [lists(small, [t])[0] for t in texts] == lists(bpe.Encoder(small.vocabulary), texts)


def test_query_like_the_library(spark, sf, library):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in queries.op7_bpe(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows_and_round_trip(spark, library):
    docs = edge_docs(spark)
    coded = bpe.encode(docs, PATH, decoded="decoded")
    rows = bpe.decode(coded, PATH, text_col="again").collect()
    assert len(rows) == docs.count() and set(coded.columns) == {*docs.columns, "decoded"}
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == r.again == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(no_docs(spark), PATH).collect() == []
    missing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(missing, PATH).collect()] == [None, ""]
