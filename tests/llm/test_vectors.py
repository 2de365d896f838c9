import math

import numpy as np

from churnspark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, codes string"


def brute_force(rows):
    ok, links = [], {}
    for k, (i, v, label, _) in enumerate(rows):
        good = i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok.append(np.float32(v).astype(float) if good else None)
        links[k] = set()
    for a in range(len(rows)):
        for b in range(a):
            x, y = ok[a], ok[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y):
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, row in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        component = None if row[0] is None else min(rows[n][0] for n in seen)
        out.append((row[0], len(links[k]), component, row[0] is not None and component == row[0]))
    return sorted(out, key=str)


def result(frame):
    return sorted((tuple(r) for r in vectors.near_duplicates(frame).collect()), key=str)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], 1, "x"), (3, [2.0, 0.0], 1, "x"), (4, [1.0, 0.0], 2, "x"), (5, [1.0, 0.0], None, "x"),
        (6, None, 1, "x"), (7, [0.0, 0.0], 1, "x"), (8, [nan, 1.0], 1, "x"), (9, [inf, 1.0], 1, "x"), (10, [None, 1.0], 1, "x"),
        (11, [], 1, "x"), (None, [1.0, 0.0], 1, "x"), (12, [1.0, -0.0], 1, "x"), (13, [1.0, 0.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x"),
        (14, [0.0, 3.0], 1, None), (15, [0.0, 3.0], 1, None),
    ]
    assert result(spark.createDataFrame(rows, SCHEMA)) == brute_force(rows)


def groups(noise):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for label in (1, 2):
        for size in (60, 5, 1, 1):
            centre = rng.standard_normal(32)
            for _ in range(size):
                near = centre + rng.standard_normal(32) * noise
                rows.append((k, near.astype(np.float32).tolist(), label, "x"))
                k += 1
    return rows + [(1000 + i, rows[3][1], 1, "x") for i in range(20)]


def test_groups_like_brute_force(spark):
    """Well above the bound the tables miss a pair less than once in 100,000."""
    rows = groups(0.08)
    got = result(spark.createDataFrame(rows, SCHEMA))
    assert got == brute_force(rows)
    assert sum(r[1] for r in got) > 3000


def test_recall_at_the_bound(spark):
    """With nearly all pairs close to the bound: no false link, and hardly one missed."""
    rows = groups(0.17)
    want = {r[0]: r[1] for r in brute_force(rows)}
    got = {r[0]: r[1] for r in result(spark.createDataFrame(rows, SCHEMA))}
    assert all(got[k] <= n for k, n in want.items())
    assert sum(got.values()) >= 0.99 * sum(want.values())


def test_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 9)
    test_groups_like_brute_force(spark)


def test_recall_of_the_tables():
    assert vectors.miss_probability(0.98) < 1e-3
    assert vectors.miss_probability(0.999) < 1e-6


def test_empty_table(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []


def test_extreme_magnitudes_link(spark):
    base = [1.0, 2.0, -3.0, 0.5]
    rows = [(k, [v * scale for v in base], "a") for k, scale in enumerate((1.0, 1e200, 1e-200, 1e307, 1e-307))]
    rows.append((9, [1e200, -1e200, 1e200, 1e200], "a"))
    found = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"))
    assert sorted((r.id, r.n_links, r.component_id) for r in found.collect()) == [(k, 4, 0) for k in range(5)] + [(9, 0, 9)]
