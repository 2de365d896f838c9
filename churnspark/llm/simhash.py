"""Near-duplicate documents by SimHash: positional byte index, tally of shared bytes, verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from churnspark.llm.graph import components
from churnspark.llm.postings import crowded
from churnspark.session import stage

WORDS = 4
SEED = 42
DISTANCE = 4
BYTES = 8
#: Two fingerprints at most DISTANCE bits apart share at least this many of their BYTES positions.
SHARED = BYTES - DISTANCE
_SLICE = 1 << 16


def index_positions() -> list[tuple[int, int, int]]:
    """The byte positions that key the index, three at a time.

    The eight positions are put in three groups; a key takes three positions of one group,
    or two of one group and one of the next. Any four positions contain such a key (a test
    goes through all of them), so a pair that shares SHARED bytes meets in some list, while
    chance meetings are 65,536 times rarer than in lists of single bytes.
    """
    group = [p % 3 for p in range(BYTES)]
    keys = []
    for three in combinations(range(BYTES), 3):
        counts = [sum(group[p] == g for p in three) for g in range(3)]
        if 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
            keys.append(three)
    return keys


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # only A-Z, only ASCII white space


def shingles(words: list[bytes], width: int = WORDS) -> Iterator[np.ndarray]:
    """The hashes of all runs of `width` words in slices; of all words together if there are fewer."""
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum([len(w) for w in words]) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    first, last = starts[:n].tolist(), ends[min(width, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(first[at:at + _SLICE], last[at:at + _SLICE])], np.uint64)


def fold(hashes: Iterable[np.ndarray]) -> int:
    """SimHash of slices of hashes as a signed 64-bit number; zero without any."""
    ones, n = np.zeros(64, np.int64), 0
    for part in hashes:
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text as a signed 64-bit number; zero without words."""
    return fold(shingles(split_words(text)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, fp long")


def _keys(fp: Column) -> Column:
    """One number per index position triple: its rank and its three bytes."""
    def byte(p: int) -> Column:
        return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))

    return F.array(*[
        F.lit(k).cast("long") * (1 << 24) + byte(a) * 65536 + byte(b) * 256 + byte(c)
        for k, (a, b, c) in enumerate(index_positions())
    ])


def block_links(values: np.ndarray, first: np.ndarray, same: bool) -> np.ndarray:
    """A spanning forest of the links between two blocks of fingerprints, as rows (a, b).

    For every value: tally of the byte positions it shares with each of the others, then the
    exact distance of those with SHARED or more.
    """
    if same:
        left = right = values
    else:
        left, right = values[first], values[~first]
    root = {int(v): int(v) for v in values}

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    forest = []
    for k, value in enumerate(left):
        others = right[k + 1:] if same else right
        differ = others ^ value
        shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1, dtype=np.int64)
        differ = differ[shared >= SHARED]
        for d in differ[np.bitwise_count(differ.view(np.uint64)) <= DISTANCE]:
            a, b = int(value), int(value ^ d)
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                forest.append((a, b))
    return np.array(forest, np.int64).reshape(-1, 2)


def links(values: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` wherever DISTANCE allows.

    Every list is compared whole, block against block, but a block pair returns only a
    spanning forest of its links: at most as many rows as it has members.
    """
    entries = values.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    groups = (
        crowded(entries, ["key"], "fp").groupBy("key", "lo", "hi")
        .agg(F.collect_list(F.struct("fp", "first")).alias("members"))
        .where(F.size("members") > 1)
        .select((F.col("lo") == F.col("hi")).alias("same"), F.col("members.fp").alias("fp"), F.col("members.first").alias("first"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum([0] + batch.column(1).value_lengths().to_pylist())
            fps = batch.column(1).flatten().to_numpy()
            firsts = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            found = [
                block_links(fps[a:b], firsts[a:b], same)
                for a, b, same in zip(ends, ends[1:], batch.column(0).to_pylist())
            ]
            pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row: the smallest id reachable over links, itself included.

    Equal fingerprints are one class before anything is compared, so a text that a third of
    all rows repeat costs one row. Defined cases: a null or empty text has fingerprint zero
    and is linked like any other; repeated rows come back as often as they were given; a null
    id never is a component's name unless all ids of the component are null; an empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(rows.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    found = components(links(classes)).select(F.col("node").alias("fp"), "component")
    named = stage(
        classes.join(found, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component")),
        "named",
    )
    names = stage(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "names")
    by_fp = stage(named.join(names, "component").select("fp", "component_id"), "by-fingerprint")
    return rows.join(by_fp, "fp").select("id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component: one document of each group, all columns.

    Rows that repeat the kept id inside its group go too, but for one; rows with a null id
    are kept only in components that consist of them (one row stays).
    """
    spark = docs.sparkSession
    numbered = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "documents")
    rows = stage(fingerprints(numbered, "__row", text_col).withColumnRenamed("id", "__row"), "fingerprints")
    ids = numbered.select("__row", F.col(id_col).alias("__id"))
    rows = stage(rows.join(ids, "__row"), "fingerprints")
    best = F.min(F.struct(F.col("__id").isNull().alias("missing"), F.col("__id"), F.col("__row")))
    classes = stage(rows.groupBy("fp").agg(best.alias("best")), "classes")
    found = components(links(classes)).select(F.col("node").alias("fp"), "component")
    kept = (
        classes.join(found, "fp", "left")
        .groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("best").alias("best"))
        .select(F.col("best.__row").alias("__row"))
    )
    kept = stage(kept, "kept")
    # most rows stay, so `kept` grows with the documents: merged at every size, never broadcast
    return numbered.join(kept.hint("merge"), "__row", "left_semi").drop("__row")
