from bisect import bisect
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import numpy as np
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from churnspark.llm import align, queries
from churnspark.llm.bpe import byte_letters
from frames import LONG, edge_docs

A = Tokenizer.from_file(queries.BYTE_BPE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
BACK = {c: b for b, c in byte_letters().items()}
SIDE_A = align.Bytes(open(queries.BYTE_BPE, encoding="utf-8").read())
PATHS = queries.BYTE_BPE, queries.PIECES


def groups(text):
    """Token ids of either side between the ends both have, by sets of offsets; none where the bytes differ."""
    if not text:
        return []
    coded = A.encode(" " + text, add_special_tokens=False)
    a, b = coded.ids, B.encode(text)
    bytes_a = [bytes(BACK[c] for c in t) for t in coded.tokens]
    bytes_b = [bytes([int(t[3:5], 16)]) if B.is_byte(k) else t.replace("▁", " ").encode() for k, t in zip(b, map(B.id_to_piece, b))]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return []
    ends_a, ends_b = (list(accumulate(map(len, side))) for side in (bytes_a, bytes_b))
    out, p, q = [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        x, y = bisect(ends_a, cut), bisect(ends_b, cut)
        out.append((a[p:x], b[q:y]))
        p, q = x, y
    return out


def brute_force(texts):
    held = [groups(t) for t in texts]
    links = [[(x, y) for u, v in g for x in u for y in v] for g in held]
    count = Counter(pair for found in links for pair in set(found))
    top: dict = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return [
        (sum(len(u) for u, _ in g), sum(len(v) for _, v in g), len(g), len(found), sum(count[p] == top[p[0]] for p in found),
         sum(count[p] for p in found), ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g))
        for g, found in zip(held, links)
    ]


@settings(max_examples=500, deadline=None)
@given(st.sets(st.integers(1, 200), max_size=80), st.sets(st.integers(1, 200), max_size=80))
def test_shared_ends_equal_set_intersection(a, b):
    a, b = (np.array(sorted(s | {201}), np.int64) for s in (a, b))
    left, right = align.shared_ends(a, b)
    both = np.intersect1d(a, b)
    assert a[left - 1].tolist() == both.tolist() == b[right - 1].tolist()


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(alphabet=" \n\t\x0b\x0c\r\x1c\x85\xa0ab's'T'll1²½éßɏ  　中文<|endoftext|>!_­​٣𝟘😀", max_size=30), st.text(max_size=20)))
def test_byte_tokens_equal_the_library(text):
    ids, _ = SIDE_A.encode([text])
    assert ids.tolist() == A.encode(text, add_special_tokens=False).ids


def test_frames_with_everything(spark, monkeypatch):
    docs = edge_docs(spark).withColumnRenamed("source", "pair").withColumnRenamed("n_chars", "bundle").withColumnRenamed("lang", "n_a")
    more = spark.createDataFrame([("a▁b",), ("<|endoftext|></s>",), (LONG,), ("中文 of the",), ("",), ("=" * 3000 + "नमस्ते" * 50,)], "text string")
    docs = docs.unionByName(more, allowMissingColumns=True)
    rows = align.link_counts(docs, *PATHS).collect()
    assert set(rows[0].asDict()) == set(docs.columns) | set(align.ADDED)
    want = brute_force([r.text for r in docs.collect()])
    got = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows]
    assert sorted(got) == sorted(want)
    assert align.link_counts(docs.limit(0), *PATHS).count() == 0
    spread = align.link_counts(docs.repartition(5), *PATHS).collect()
    assert sorted(r.count_sum for r in spread) == sorted(w[5] for w in want)


def test_large_groups_and_small_blocks_give_the_same(monkeypatch):
    tools = align.Tools(SIDE_A.tool.to_str(), open(queries.PIECES, "rb").read())
    texts = ["नमस्ते दुनिया 中文 and so on " * 3, None, "plain words", "é" * 40]
    want = [v.tolist() for v in align.Aligned(tools, texts).pairs()]
    monkeypatch.setattr(align, "SMALL", 0)
    assert [v.tolist() for v in align.Aligned(tools, texts).pairs()] == want
    monkeypatch.setattr(align, "SMALL", 65_536)
    monkeypatch.setattr(align, "LINKS_AT_ONCE", 3)
    assert [v.tolist() for v in align.Aligned(tools, texts).pairs()] == want


def test_alignment_holds_all_tokens(spark):
    rows = align.align(spark.createDataFrame([(1, "of the 中文 words"), (2, None), (3, "x▁y")], "doc_id long, text string"), *PATHS).collect()
    for r in rows:
        want = groups(r.text)
        assert r.a_ids == [k for u, _ in want for k in u] and r.b_ids == [k for _, v in want for k in v]
        assert (r.a_sizes, r.b_sizes) == ([len(u) for u, _ in want], [len(v) for _, v in want])


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([d.doc_id for d in docs], brute_force([d.text for d in docs])))
    rows = queries.op13_cross_tokenizer_alignment(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        *figures, listed = want[r.doc_id]
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum] == figures
        assert r.groups_sha256 == (sha256(listed.encode()).hexdigest() if listed else "")


def test_entries_are_written_side_by_side_across_chunks(monkeypatch):
    entries = [b"", b"ab", b"\xff", "é".encode(), b"long one"]
    numbers = np.random.default_rng(3).integers(0, len(entries), 1000)
    for chunk in (1, 7, 1000, 5000):
        monkeypatch.setattr(align, "WRITTEN_AT_ONCE", chunk)
        assert align.Spelling(entries).write(numbers).tobytes() == b"".join(entries[k] for k in numbers)
    assert align.Spelling(entries).write(numbers[:0]).tobytes() == b""


def test_only_texts_that_come_back_have_tokens():
    """The check of one text does not read the bytes of its neighbours."""
    tools = align.Tools(SIDE_A.tool.to_str(), open(queries.PIECES, "rb").read())
    texts = ["one two", None, "a▁b", "", "one two", "▁", "three"]
    found = align.Aligned(tools, texts)
    assert [bool(n) for n in found.n_a] == [True, False, False, False, True, False, True]
    listed = found.listed()
    assert listed[0] == listed[4] and [bool(g) for g in listed] == [bool(n) for n in found.n_a]
    assert not listed[6].endswith((b",", b";", b"|")) and listed[6].count(b"|") == found.n_groups[6]
