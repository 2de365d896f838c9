"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.graph import components
from churnspark.llm.postings import crowded
from churnspark.session import stage

TABLES = 24
BITS = 20
COSINE = 0.98
BLOCK = 256
SEED = 7


def miss_probability(cosine: float, tables: int = TABLES, bits: int = BITS) -> float:
    """Chance that two vectors of this cosine share no list: each bit agrees with 1 - angle/pi."""
    agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return float((1 - agree**bits) ** tables)


def sign_codes(vectors: np.ndarray, tables: int = TABLES, bits: int = BITS) -> np.ndarray:
    """One number per table: the signs of the vector against the table's hyperplanes."""
    planes = np.random.default_rng([SEED, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits))


def _classes(vectors: DataFrame) -> DataFrame:
    """(cid, label, embedding, copies, first_id) of every distinct comparable vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & finite & F.exists("embedding", lambda x: x != 0)
    )
    return (
        vectors.where(usable).groupBy("label", "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"))
        .withColumn("cid", F.monotonically_increasing_id())
    )


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: exact, and no square overflows or vanishes."""
    if not vectors.size:
        return vectors
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def _entries(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """classes with `codes`, one per table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, wide = batch.column(0), batch.column(1)
            sizes = wide.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            flat = wide.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            codes = np.empty((len(cids), tables), np.int64)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                codes[rows] = sign_codes(scaled(flat[(ends[rows] - size)[:, None] + np.arange(size)]), tables, bits)
            lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, tables, dtype=np.int32), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([cids, lists], names=["cid", "codes"])

    return classes.select("cid", "embedding").mapInArrow(run, "cid long, codes array<long>")


def block_pairs(vectors: np.ndarray, codes: np.ndarray, first: np.ndarray, table: int, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the linked pairs of a block pair that meet in no table before this one."""
    vectors = scaled(vectors)
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    a = np.arange(len(vectors)) if same else np.flatnonzero(first)
    b = np.arange(len(vectors)) if same else np.flatnonzero(~first)
    close = (vectors[a] @ vectors[b].T) / np.outer(norms[a], norms[b]) >= least
    if same:
        close &= a[:, None] < b[None, :]
    i, j = np.nonzero(close)
    i, j = a[i], b[j]
    new = ~(codes[i, :table] == codes[j, :table]).any(axis=1) if table else np.ones(len(i), bool)
    return i[new], j[new]


def _forest(cids: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(len(cids)))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    edges = []
    for a, b in zip(i.tolist(), j.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            edges.append((int(cids[a]), int(cids[b])))
    return edges


def _compare(groups: DataFrame, least: float) -> DataFrame:
    """(a, b, n): a with b null carries n linked copies of others; a, b with n null is an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int | None, int | None]] = []
            for row in batch.to_pylist():
                cids = np.array(row["cid"], np.int64)
                copies = np.array(row["copies"], np.int64)
                i, j = block_pairs(
                    np.array(row["embedding"], np.float64), np.array(row["codes"], np.int64),
                    np.array(row["first"], bool), row["table"], row["same"], least,
                )
                n = np.bincount(i, copies[j], len(cids)) + np.bincount(j, copies[i], len(cids))
                out += [(int(cids[k]), None, int(n[k])) for k in np.flatnonzero(n)]
                out += [(a, b, None) for a, b in _forest(cids, i, j)]
            a, b, n = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], names=["a", "b", "n"])

    return groups.mapInArrow(run, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    least: float = COSINE, tables: int = TABLES, bits: int = BITS,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors of a label are one class with a number of copies, so a vector that a third
    of the rows repeat is compared once. Classes meet in the lists of a table when all signs
    agree; lists are compared whole in blocks, a pair is counted in the first table where it
    meets, and a block pair returns link counts and a spanning forest, never its pairs. The
    tables miss a pair of cosine `least` with `miss_probability`.

    Defined cases: a null, zero or partly null or non-finite vector, a null label or a null id
    links with nothing (n_links 0, its own component); vectors of different lengths never link; components
    may be as large or small as a double holds;
    repeated rows are vectors of their own; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        # -0.0 equals 0.0 in a comparison, so it must also in a grouping
        F.transform(vector_col, lambda x: x.cast("double") + F.lit(0.0)).alias("embedding"),
        F.col(label_col).cast("string").alias("label"),
    )
    classes = stage(_classes(rows), "classes")
    coded = stage(_entries(classes, tables, bits), "codes")
    light = (
        classes.select("cid", "label", F.size("embedding").alias("size")).join(coded, "cid")
        .select("cid", "label", "size", F.posexplode("codes").alias("table", "code"))
    )
    keys = ["label", "size", "table", "code"]
    dealt = crowded(light, keys, "cid", BLOCK)
    full = classes.select("cid", "embedding", "copies").join(coded, "cid")
    groups = (
        dealt.join(full, "cid")
        .groupBy(*keys, "lo", "hi")
        .agg(F.collect_list(F.struct("cid", "copies", "embedding", "codes", "first")).alias("m"))
        .where(F.size("m") > 1)
        .select(
            "table", (F.col("lo") == F.col("hi")).alias("same"),
            *[F.col(f"m.{c}").alias(c) for c in ("cid", "copies", "embedding", "codes", "first")],
        )
    )
    met = stage(_compare(groups, least), "links")
    linked = met.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    found = components(met.where("b is not null").select("a", "b"))
    named = stage(
        classes.select("cid", "first_id", "copies", "label", "embedding")
        .join(found.withColumnRenamed("node", "cid"), "cid", "left")
        .join(linked, "cid", "left")
        .select(
            "cid", "label", "embedding", "first_id", F.coalesce("component", "cid").alias("component"),
            (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        ),
        "named",
    )
    names = stage(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "names")
    by_vector = stage(named.join(names, "component").select("label", "embedding", "n_links", "component_id"), "by-vector")
    joined = rows.join(by_vector, ["label", "embedding"], "left")
    own = F.col("id").isNotNull()  # a row without an id is in no class
    component = F.when(own, F.coalesce("component_id", "id"))
    return joined.select(
        "id", F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )
