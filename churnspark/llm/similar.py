"""One document of each group of similar texts: wide candidates, exact Jaccard of five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from churnspark.llm import simhash
from churnspark.llm.graph import components
from churnspark.llm.tables import slices, unused
from churnspark.session import stage

WORDS = 5
LEAST = (4, 5)  # a fraction, so that the test of a pair is exact
#: A pair is a candidate if all ROWS minima of one of BANDS bands agree, or by the byte index of SimHash.
BANDS, ROWS = 24, 5
#: Texts of one list that are compared in a task at a time, twice over.
BLOCK = 128
#: Rounds that compare every list with one of its members before members are compared with each other.
STARS = 2
_SLICE = 4096
_rng = np.random.default_rng(simhash.SEED)
_TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def miss_probability(similarity: float) -> float:
    """Chance that the bands alone never bring together a pair of this similarity."""
    return (1 - similarity**ROWS) ** BANDS


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key per band of a set of shingle hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _SLICE):
        least = np.minimum(least, (hashes[at:at + _SLICE, None] * _TIMES + _PLUS).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_set(words: list[bytes]) -> np.ndarray:
    parts = [np.unique(part) for part in simhash.shingles(words, WORDS)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _sketches(texts: DataFrame) -> DataFrame:
    """(node, digest of the words, SimHash, band keys) of every row of `texts` (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, fps, keys = [], [], []
            for text in batch.column(1).to_pylist():
                words = simhash.split_words(text)
                digests.append(blake2b(b" ".join(words), digest_size=16).digest())
                fps.append(simhash.fold(simhash.shingles(words, WORDS)))
                keys.append(band_keys(shingle_set(words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["node", "digest", "fp", "keys"],
            )

    return texts.mapInArrow(run, "node long, digest binary, fp long, keys array<long>")


def block_links(nodes: np.ndarray, first: np.ndarray, same: bool, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with a Jaccard similarity of LEAST or more, exactly.

    Shared shingles are counted through an inverted list over the members of the group.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner = owner[np.argsort(code, kind="stable")]
    ends = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(values)))))
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    forest = []
    for k in range(len(sets)) if same else np.nonzero(first)[0].tolist():
        mine = code[starts[k]:starts[k + 1]]
        lengths = ends[mine + 1] - ends[mine]
        at = np.repeat(ends[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(owner[at], minlength=len(sets))
        near = LEAST[1] * shared >= LEAST[0] * (sizes[k] + sizes - shared)
        near &= np.arange(len(sets)) > k if same else ~first
        for other in np.nonzero(near)[0].tolist():
            ra, rb = find(k), find(other)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                forest.append((int(nodes[k]), int(nodes[other])))
    return forest


def lists(sketches: DataFrame) -> DataFrame:
    """(key, node): lists of two nodes or more of `sketches` (node, fp, keys) which may be similar.

    A key stands for a band, or for the fingerprints that the byte index of SimHash connects. Of lists
    with the same members one is left.
    """
    texts = sketches.where(F.size("keys") > 0)
    prints = stage(texts.select("fp").distinct(), "fingerprints")
    close = components(simhash.links(prints)).select(F.col("node").alias("fp"), "component")
    by_print = texts.select("node", "fp").join(close, "fp", "left").select(F.coalesce("component", "fp").alias("key"), "node")
    entries = by_print.unionByName(sketches.select(F.explode("keys").alias("key"), "node")).distinct()
    # the members in two independent hashes, so that a list is only left out for an equal one
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in range(2)]
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    keys = keys.groupBy("n", "h0", "h1").agg(F.min("key").alias("key")).select("key")
    return entries.join(keys, "key")


def _sets(texts: DataFrame) -> DataFrame:
    """(node, sh): the shingles of every row of `texts` (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [shingle_set(simhash.split_words(t)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "sh"])

    return texts.mapInArrow(run, "node long, sh array<long>")


def _compared(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) found in the groups of `members` (key, lo, hi, node, first), each of bounded size."""
    groups = (
        members.join(sets, "node").groupBy("key", "lo", "hi")
        .agg(F.collect_list(F.struct("node", "first", "sh")).alias("members"))
        .where(F.size("members") > 1)
        .select((F.col("lo") == F.col("hi")).alias("same"), F.col("members.node").alias("node"),
                F.col("members.first").alias("first"), F.col("members.sh").alias("sh"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = block_links(
                batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(zero_copy_only=False),
                batch.column(0)[0].as_py(), [s.values.to_numpy().view(np.uint64) for s in batch.column(3).flatten()],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"]
            )

    return groups.mapInArrow(run, "a long, b long")


def stars(open_lists: DataFrame, turn: int) -> DataFrame:
    """Every member of a list against one node of it, the hub, which stands in each block of members.

    `open_lists` has key, node and `rest`, true for nodes outside the largest connected part of
    their list: the hub is one of them. A pair that several lists propose is compared once.
    """
    order = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node"))
    hubs = open_lists.where("rest").groupBy("key").agg(F.min(order)["node"].alias("hub"))
    pairs = open_lists.join(hubs, "key").where("node <> hub").select("hub", "node").distinct()
    sizes = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    spokes = pairs.join(sizes, "hub").select(
        F.col("hub").alias("key"), F.lit(-1).alias("lo"), F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("hi"),
        "node", F.lit(False).alias("first"),
    )
    centres = sizes.select(
        F.col("hub").alias("key"), F.lit(-1).alias("lo"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("hi"),
        F.col("hub").alias("node"), F.lit(True).alias("first"),
    )
    return spokes.unionByName(centres)


def across(open_lists: DataFrame) -> DataFrame:
    """Members of open lists dealt into pairs of blocks: those outside the largest connected part against all.

    Two nodes of that part are connected already and need no comparison, so a list of n nodes of which r lie outside
    makes n * ceil(r / BLOCK) + r * ceil(n / BLOCK) rows at most.
    """
    sizes = open_lists.groupBy("key").agg(
        F.ceil(F.sum(F.col("rest").cast("int")) / BLOCK).cast("int").alias("outside"),
        F.ceil(F.sum((~F.col("rest")).cast("int")) / BLOCK).cast("int").alias("inside"),
    )
    rest, mixed = F.col("rest"), F.xxhash64("node")
    mine = F.when(rest, F.pmod(mixed, F.col("outside"))).otherwise(F.col("outside") + F.pmod(mixed, F.greatest("inside", F.lit(1))))
    last = F.when(rest, F.col("outside") + F.col("inside")).otherwise(F.col("outside")) - 1
    return (
        open_lists.join(sizes, "key").withColumn("mine", mine.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
        .select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "node",
                (F.col("mine") <= F.col("other")).alias("first"))
    )


def _open(entries: DataFrame, parts: DataFrame | None) -> DataFrame:
    """(key, node, rest) of the lists that `parts` (node, component) does not connect yet."""
    named = entries.withColumn("part", F.col("node"))
    if parts is not None:
        named = entries.join(parts, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    counted = named.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("key").agg(
        F.max(F.struct("n", "part"))["part"].alias("largest"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")
    )
    # the first star of a list of two has compared it whole
    still = largest.where(F.col("parts") > 1).where(F.col("n") > (1 if parts is None else 2)).drop("n")
    return named.join(still, "key").select("key", "node", (F.col("part") != F.col("largest")).alias("rest"))


def connected(entries: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component): what the links of LEAST or more among the nodes of a list connect.

    `entries` are lists (key, node), `texts` (node, text). First STARS rounds compare each list with one of its nodes, which
    connects most lists whole at a cost that grows with their length; then the nodes that are still outside the largest part of their
    list are compared with all of it, in pairs of blocks, so no link between two parts is left out.
    """
    sets = stage(_sets(texts.join(entries.select("node").distinct().hint("merge"), "node")), "sets")
    edges = parts = None
    for turn in range(STARS + 1):
        left = stage(_open(entries, parts), "open-lists")
        if left.isEmpty():
            break
        found = stage(_compared(stars(left, turn) if turn < STARS else across(left), sets), "links")
        edges = found if edges is None else edges.unionByName(found)
        parts = components(edges)
    return sets.select("node", F.col("node").alias("component")).limit(0) if parts is None else parts


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of similar texts, the one with the smallest id, all columns.

    Two texts are similar if the sets of their five-word shingles have a Jaccard similarity of 0.8
    or more (lower case, words cut at white space; fewer words are one shingle); groups
    are closed under similarity. Every link is verified on the texts; `miss_probability` bounds what the
    candidates miss. Defined cases: null texts and texts without words are alike; rows with a null
    id are kept only in groups that consist of them (one row stays); an empty table gives an
    empty result.
    """
    row = unused(docs, "row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    texts = numbered.select(F.col(row).alias("node"), F.col(text_col).cast("string").alias("text"))
    sketches = stage(_sketches(texts), "sketches")
    ids = numbered.select(F.col(row).alias("node"), F.col(id_col).alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("node")))
    classes = sketches.select("node", "digest").join(ids, "node").groupBy("digest").agg(best.alias("best"))
    classes = stage(classes.select(F.col("best.node").alias("node"), "best"), "classes")
    # most rows stay, so these grow with the documents: merged at every size, never broadcast
    nodes = stage(sketches.join(classes.select("node").hint("merge"), "node", "left_semi"), "nodes")
    found = connected(stage(lists(nodes), "lists"), texts).select("node", F.col("component").alias("group"))
    kept = (
        classes.join(found, "node", "left")
        .groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("best").alias("best"))
        .select(F.col("best.node").alias(row))
    )
    return numbered.join(stage(kept, "kept").hint("merge"), row, "left_semi").drop(row)
