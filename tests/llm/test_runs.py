import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from churnspark.llm import queries, runs
from frames import LONG, edge_docs


def brute_force(words, times=runs.TIMES, least=runs.LEAST):
    """Every period and every stretch, smallest periods only."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            seg = words[i:i + length]
            if j > i and length >= max(least, times * q) and not any(seg[r:] == seg[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, found):
    drop = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


@settings(max_examples=400, deadline=None)
@given(
    st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 7), st.integers(1, 40)), max_size=8),
    st.sampled_from([(4, 6), (3, 2), (5, 1)]),
)
def test_runs_equal_brute_force(parts, law):
    words = [w for block, times, cut in parts for w in (block * times)[:cut]]
    assert [tuple(r) for r in runs.periodic_runs(np.array(words, np.int64), *law).tolist()] == brute_force(words, *law)


def test_frames_with_everything(spark):
    docs = edge_docs(spark).withColumnRenamed("lang", "runs")
    found = runs.find_runs(docs)
    assert set(found.columns) == {*docs.columns, "collapsed"} and found.count() == docs.count()
    for r in found.collect():
        words = split(r.text)
        if len(words) < 1000:
            want = brute_force(words)
            assert [tuple(x) for x in r.runs] == want and r.collapsed == collapsed(words, want)
    (long,) = runs.find_runs(spark.createDataFrame([(LONG,)], "text string")).collect()
    assert [tuple(x) for x in long.runs] == [(0, 60_000, 3)] and long.collapsed == "lorem ipsum dolor"
    assert runs.find_runs(docs.limit(0)).count() == 0


def test_words_are_cut_at_the_six_spaces_only(spark):
    (r,) = runs.find_runs(spark.createDataFrame([("a\xa0b\x0ba\xa0b\fa\xa0b\ta\xa0b\ra\xa0b\na\xa0b\x1c",)], "text string")).collect()
    assert [tuple(x) for x in r.runs] == [] and len(r.collapsed.split(" ")) == 6


def test_fewer_than_three_periods_are_refused(spark):
    with pytest.raises(ValueError):
        runs.find_runs(spark.createDataFrame([("a",)], "text string"), times=2)


def test_query_equals_brute_force(spark, sf):
    from hashlib import sha256

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_periodic_runs(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs) and sum(r.n_runs > 0 for r in rows) > 10
    for r in rows:
        words = split(docs[r.doc_id])
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue
        found = brute_force(words)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == sha256("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(collapsed(words, found).encode()).hexdigest()
