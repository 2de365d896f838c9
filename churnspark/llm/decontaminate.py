"""Benchmark leaks in training text: BM25 index of the test items, block-max pruning, verified overlap."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.tables import add_columns, place, slices
from churnspark.session import stage

K1, B = 1.2, 0.75
#: A passage is retrieved if it reaches this share of the score the item has with itself.
THRESHOLD = 0.5
#: Share of the words of the question and of the answer that must follow in the passage in order.
OVERLAP = 0.8
#: Items whose scores are bounded together.
ITEMS_PER_BLOCK = 16
#: Shortest length class in words; an item of length class c is looked for in passages of 2c words, c apart.
SHORTEST = 64
#: An index broadcast to the workers holds about this many words of items; more items make more indexes.
INDEX_WORDS = 2_000_000
_WORDS = re.compile(r"\w+").findall
_SENTENCE = re.compile(r"(?<=[.?!])\s+")
LEAK = "array<struct<item_id:bigint,score:double,question:double,answer:double>>"


def words_of(text: str | None) -> list[str]:
    return _WORDS((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last line, else the last sentence, else the last quarter of the words."""
    for parts in ([p for p in text.split("\n") if words_of(p)], [p for p in _SENTENCE.split(text) if words_of(p)]):
        if len(parts) > 1:
            return list(chain.from_iterable(map(words_of, parts[:-1]))), words_of(parts[-1])
    words = words_of(text)
    cut = len(words) - max(1, len(words) // 4)
    return (words[:cut], words[cut:]) if cut else (words, words)


def in_order(wanted: list[str], passage: list[str]) -> float:
    """Share of the wanted words that occur in the passage in their order (longest common subsequence).

    One bit per wanted word; a word of the passage is one addition on the bits.
    """
    if not wanted:
        return 0.0
    masks: dict[str, int] = {}
    for k, w in enumerate(wanted):
        masks[w] = masks.get(w, 0) | 1 << k
    full = row = (1 << len(wanted)) - 1
    for w in passage:
        met = row & masks.get(w, 0)
        if met:
            row = ((row + met) | (row - met)) & full
    return 1 - row.bit_count() / len(wanted)


def _expand(lists: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every entry of `lists`, the places of its posting list, and which entry they belong to."""
    size = starts[lists + 1] - starts[lists]
    owner = np.repeat(np.arange(len(lists)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[lists], size), owner


@dataclass
class Index:
    """Impacts of the words of items of one length class, as shares of the items' scores with themselves."""

    size: int                 # length class in words
    items: list[int]          # positions in the list of all items of the index
    starts: np.ndarray        # posting list of word w: starts[w]:starts[w + 1]
    item: np.ndarray
    impact: np.ndarray
    highest: np.ndarray       # of each word over all items
    block_starts: np.ndarray  # the same lists by block of items
    block: np.ndarray
    block_highest: np.ndarray

    @classmethod
    def build(cls, size: int, items: list[int], rows: list[dict[int, float]], vocabulary: int) -> Index:
        entries = sorted((w, k, v) for k, row in enumerate(rows) for w, v in row.items())
        word = np.array([e[0] for e in entries], np.int64)
        item = np.array([e[1] for e in entries], np.int64)
        impact = np.array([e[2] for e in entries])
        starts = np.searchsorted(word, np.arange(vocabulary + 1))
        highest = np.zeros(vocabulary)
        np.maximum.at(highest, word, impact)
        blocks = len(items) // ITEMS_PER_BLOCK + 1
        key, back = np.unique(word * blocks + item // ITEMS_PER_BLOCK, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, back, impact)
        return cls(
            size, items, starts, item, impact, highest,
            np.searchsorted(key // blocks, np.arange(vocabulary + 1)), key % blocks, top,
        )

    def search(self, place_: np.ndarray, doc: np.ndarray, word: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(document, first word, item, score) of all passages and items at or above the threshold.

        The known words of many documents come in a row. A passage is scored against no item if the
        highest impacts of its words cannot add up to the threshold, against no block of items if
        the block's highest impacts cannot, and exactly otherwise.
        """
        if not len(word):
            return []
        part = place_ // self.size
        width = int(part.max()) + 2
        # word n belongs to the passage that begins with its part and to the one before
        passage = np.concatenate((doc * width + part + 1, doc * width + part))
        pair = np.unique(passage * len(self.highest) + np.concatenate((word, word)))
        passage, word = pair // len(self.highest), pair % len(self.highest)
        slack = 1e-9
        number, back = np.unique(passage, return_inverse=True)
        possible = np.bincount(back, self.highest[word], len(number)) >= threshold - slack
        chosen = possible[back]
        back, word = back[chosen], word[chosen]
        blocks = len(self.items) // ITEMS_PER_BLOCK + 1
        at, owner = _expand(word, self.block_starts)
        key, where = np.unique(back[owner] * blocks + self.block[at], return_inverse=True)
        open_blocks = key[np.bincount(where, self.block_highest[at], len(key)) >= threshold - slack]
        chosen = np.isin(back, open_blocks // blocks)
        back, word = back[chosen], word[chosen]
        at, owner = _expand(word, self.starts)
        item = self.item[at]
        chosen = np.isin(back[owner] * blocks + item // ITEMS_PER_BLOCK, open_blocks)
        key, where = np.unique((back[owner] * len(self.items) + item)[chosen], return_inverse=True)
        score = np.bincount(where, self.impact[at][chosen], len(key))
        hit = np.flatnonzero(score >= threshold - slack)
        out = []
        for k, s in zip(key[hit].tolist(), score[hit].tolist()):
            p = int(number[k // len(self.items)])
            out.append((p // width, max(0, (p % width - 1) * self.size), self.items[k % len(self.items)], s))
        return out


@dataclass
class Benchmark:
    """Some items of a benchmark, indexed by length class."""

    ids: list[int | None]
    parts: list[tuple[list[str], list[str]]]
    vocabulary: dict[str, int]
    indexes: list[Index]

    @classmethod
    def build(cls, rows: list, items: int, mean_words: float) -> Benchmark:
        """rows: id, text parts, words with their counts and the number of items that have them."""
        vocabulary = {w: k for k, w in enumerate(sorted({w for r in rows for w in r["words"]}))}
        classes: dict[int, list[int]] = {}
        weights: list[dict[int, float]] = []
        for k, r in enumerate(rows):
            length = sum(r["counts"])
            norm = K1 * (1 - B + B * length / mean_words)
            row = {
                vocabulary[w]: math.log(1 + (items - d + 0.5) / (d + 0.5)) * n * (K1 + 1) / (n + norm)
                for w, n, d in zip(r["words"], r["counts"], r["in_items"])
            }
            total = sum(row.values())
            weights.append({w: v / total for w, v in row.items()})
            classes.setdefault(max(SHORTEST, 1 << (length - 1).bit_length()), []).append(k)
        return cls(
            [r["item_id"] for r in rows], [(list(r["question"]), list(r["answer"])) for r in rows], vocabulary,
            [Index.build(size, ks, [weights[k] for k in ks], len(vocabulary)) for size, ks in sorted(classes.items())],
        )

    def leaks(self, texts: list[str | None], threshold: float, overlap: float) -> list[list[dict]]:
        """For each text the items that some passage of it holds, each with its best passage."""
        split = [words_of(t) for t in texts]
        get = self.vocabulary.get
        known = np.fromiter((get(w, -1) for w in chain.from_iterable(split)), np.int64)
        sizes = np.array([len(w) for w in split], np.int64)
        at = np.flatnonzero(known >= 0)
        doc = np.repeat(np.arange(len(split)), sizes)[at]
        place_ = at - (np.cumsum(sizes) - sizes)[doc]
        best: list[dict[int, dict]] = [{} for _ in texts]
        for index in self.indexes:
            for d, first, item, score in index.search(place_, doc, known[at], threshold):
                passage = split[d][first:first + 2 * index.size]
                question, answer = (in_order(p, passage) for p in self.parts[item])
                if min(question, answer) >= overlap - 1e-9:
                    found = {"item_id": self.ids[item], "score": score, "question": question, "answer": answer}
                    if score > best[d].get(item, found | {"score": -1.0})["score"]:
                        best[d][item] = found
        return [[found[k] for k in sorted(found)] for found in best]


def _indexes(items: DataFrame, id_col: str, text_col: str, index_words: int) -> Iterator[Benchmark]:
    """Indexes of about `index_words` words each; counts of items per word are over all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(words_of(text))
                if counts:
                    question, answer = question_and_answer(text)
                    rows.append({"item_id": item, "words": list(counts), "counts": list(counts.values()), "question": question, "answer": answer})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("item_id", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())),
                ("question", pa.list_(pa.string())), ("answer", pa.list_(pa.string())),
            ]))

    split = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "item_id long, words array<string>, counts array<int>, question array<string>, answer array<string>"
    )
    split = stage(split.withColumn("row", F.monotonically_increasing_id()), "benchmark")
    length = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    total = split.select(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(length), F.lit(0)).alias("words")).first()
    if not total["items"]:
        return
    pairs = split.select("row", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))).alias("p"))
    pairs = pairs.select("row", F.col("p.word").alias("word"), F.col("p.n").alias("n"))
    in_items = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("in_items"))
    known = pairs.join(in_items, "word").groupBy("row").agg(F.collect_list(F.struct("word", "n", "in_items")).alias("e"))
    full = stage(split.drop("words", "counts").join(known, "row"), "benchmark-index")
    blocks = -(-total["words"] // index_words)
    for block in range(blocks):
        rows = full.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").select(
            "item_id", "question", "answer", F.col("e.word").alias("words"), F.col("e.n").alias("counts"), F.col("e.in_items").alias("in_items")
        ).collect()
        yield Benchmark.build(rows, total["items"], total["words"] / total["items"])


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    threshold: float = THRESHOLD, overlap: float = OVERLAP, index_words: int = INDEX_WORDS,
) -> DataFrame:
    """`docs` with `leaks`: the benchmark items that a passage of the whole text holds.

    Every passage (as long as two items of the length class, one item apart, so that no item is
    cut) is a query to a BM25 index of the items; all items at or above `threshold` of their own
    score are retrieved, without a limit, and stay if `overlap` of the words of their question and
    of their answer follow in the passage in order. The documents are read once per index and
    never shuffled; an index is broadcast and holds about `index_words` words whatever the benchmark.

    Defined cases: a null or empty text, or one without a word, has no leaks; items without a word
    are left out; repeated items are reported each, repeated rows come back as often; a null
    item id is reported as null; empty tables give no leaks; an input column called leaks is replaced.
    """
    spark = docs.sparkSession
    out = docs.drop("leaks")
    parts = []
    for k, benchmark in enumerate(_indexes(items, item_id_col, item_text_col, index_words)):
        shared = spark.sparkContext.broadcast(benchmark)
        parts.append(f"__leaks{k}")
        at = place(out, text_col)

        def run(batch: pa.RecordBatch, shared=shared, at=at) -> list:
            found = shared.value.leaks(batch.column(at).to_pylist(), threshold, overlap)
            return [pa.array(found, pa.list_(pa.struct([
                ("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])))]

        out = add_columns(out, run, **{parts[-1]: LEAK})
    whole = F.concat(*parts) if parts else F.array().cast(LEAK)
    return out.withColumn("leaks", whole).drop(*parts)
