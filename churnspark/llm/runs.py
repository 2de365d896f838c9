"""Periodic runs of words, found with a dictionary of basic factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from churnspark.llm.tables import add_columns, place

#: A run repeats its period at least this often and has at least this many words.
TIMES, LEAST = 4, 6
#: UTF-8 bytes of texts whose words are held as numbers at a time; a longer text is held alone.
BYTES_AT_ONCE = 4_000_000
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all maximal runs of a sequence of numbers, by start, then period.

    Basic factors are the stretches of 1, 2, 4, … words; equal ones have one name, made of the
    names of their halves. Where a factor comes again within a window of twice its length, at
    distance d, the words repeat with period d over both, and neighbouring places with the same
    distance are an arithmetic progression of one run. A factor not shorter than the smallest
    period never comes again sooner than that, so a stretch of such places is the whole run,
    as far as it can be extended on both sides: no word need be compared again. Runs found
    with factors of several lengths are the same and are kept once. Places whose factor is
    found nowhere else are left out of all longer factors, so plain prose ends after a few rounds.
    """
    found = [np.empty((0, 3), np.int64)]
    at, name, size = np.arange(len(words), dtype=np.int64), words, 1
    # three periods of p words hold two factors of p to 2p - 1 words, p apart
    while len(at) > 1 and size < len(words):
        order = np.argsort(name, kind="stable")
        by_name = name[order]
        same = by_name[1:] == by_name[:-1]
        after = np.zeros(len(at), np.int64)
        step = at[order[1:]] - at[order[:-1]]
        after[order[:-1]] = np.where(same & (step <= size), step, 0)
        found.append(_stretches(at, after, size, times, least))
        # the names of the next factors, for places where both halves are found elsewhere too
        many = np.zeros(len(at), bool)
        many[order[1:]] |= same
        many[order[:-1]] |= same
        number = np.empty(len(at), np.int64)
        number[order] = np.concatenate(([0], np.cumsum(~same)))
        kept, numbers = at[many], number[many]
        right = np.searchsorted(kept, kept + size)
        both = right < len(kept)
        both[both] = kept[right[both]] == kept[both] + size
        name = numbers[both] * len(words) + numbers[right[both]]
        at, size = kept[both], 2 * size
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def _stretches(at: np.ndarray, after: np.ndarray, size: int, times: int, least: int) -> np.ndarray:
    """(start, period, length) of the runs seen as neighbouring places with one distance to their successor."""
    place_, step = at[after > 0], after[after > 0]
    if not len(step):
        return np.empty((0, 3), np.int64)
    cut = np.flatnonzero((np.diff(place_) != 1) | (np.diff(step) != 0)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [len(step)])) - 1
    period = step[first]
    length = place_[last] - place_[first] + size + period
    long = length >= np.maximum(least, times * period)
    return np.stack((place_[first], period, length), axis=1)[long]


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay when every run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def _groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    first = held = 0
    for k, size in enumerate(sizes):
        if k > first and held + size > most:
            yield first, k
            first, held = k, 0
        held += size
    if sizes:
        yield first, len(sizes)


def _numbers(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Words of several texts in a row as numbers, a number of its own between two texts, and where each text begins.

    A word has another number in every text, so nothing is found to repeat across texts.
    """
    out, begins, top = [], [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        begins.append(begins[-1] + len(out[-1]) if out else 0)
        out.append([top + seen.setdefault(w, len(seen)) for w in words])
        top += len(seen)
        out[-1].append(top)
        top += 1
    flat = np.fromiter((k for part in out for k in part), np.int64)
    return flat, np.array([*begins, len(flat)], np.int64)


def find_runs(
    docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str | None = "collapsed",
    times: int = TIMES, least: int = LEAST,
) -> DataFrame:
    """All columns of `docs`, the runs of words of each text, and with `collapsed_col` the text without the repeats.

    Words lie between spaces, tabs, line feeds, vertical tabs, form feeds and carriage returns. A
    run is a stretch of at least max(`least`, `times` · q) words with smallest period q that cannot
    be extended; runs come by start, then period. The collapsed text is the words outside all
    runs and those of each run's first period (unless another run repeats them), joined by a
    space. Defined cases: a null or empty text, or one of white space only, has no runs and collapses
    to an empty text; texts of any length are searched whole, in memory that grows with the
    text and not with its square; repeated rows and ties are answered alike; an empty table gives an empty
    result; columns already called like a result are replaced, all others, whatever their names, stay.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found by factors within twice their length")
    new = {runs_col: RUNS} | ({collapsed_col: "string"} if collapsed_col else {})
    at = place(docs, text_col, *new)

    def run(batch: pa.RecordBatch) -> list:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        rows, sizes, collapsed = [], [], []
        for a, b in _groups([len(t or b"") for t in texts], BYTES_AT_ONCE):
            split = [(t or b"").split() for t in texts[a:b]]
            flat, begins = _numbers(split)
            runs = periodic_runs(flat, times, least)
            bounds = np.searchsorted(runs[:, 0], begins)
            sizes += np.diff(bounds).tolist()
            owner = np.repeat(np.arange(len(split)), np.diff(bounds))
            if collapsed_col:
                stay = without_repeats(len(flat), runs)
                for k, words in enumerate(split):
                    if bounds[k] < bounds[k + 1]:
                        words = [w for w, s in zip(words, stay[begins[k]:begins[k + 1]].tolist()) if s]
                    collapsed.append(b" ".join(words))
            rows.append(runs - np.stack((begins[owner], 0 * owner, 0 * owner), axis=1))
        flat_rows = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
        struct = pa.StructArray.from_arrays([pa.array(flat_rows[:, k]) for k in range(3)], names=["start", "length", "period"])
        out = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), struct)]
        return out + ([pa.array(collapsed, pa.binary()).cast(pa.string())] if collapsed_col else [])

    return add_columns(docs, run, **new)


def longest(runs: Column) -> Column:
    """The run of greatest length as a struct; of equal ones the one with the smallest start, then period; null if none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return F.when(F.size(runs) > 0, F.struct((-best["s"]).alias("start"), best["length"].alias("length"), (-best["p"]).alias("period")))


def listed(runs: Column) -> Column:
    """Every run as a line of start, length and period."""
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(line, "")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a period planted into every text whose id hashes to a multiple of ten; the others as they are.

    With h the CRC32 of the decimal id, g = h / 10 and n words, word i from a = g mod n on becomes word
    a + (i - a) mod p, p = 1 + (n - a) / (3 + g mod 8), divisions rounded down. A null id plants nothing.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))

    def repeated(held: Column) -> Column:
        g, n = F.floor(h / 10), F.size(held)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(held, lambda w, i: F.when(i < a, w).otherwise(F.get(held, (a + (i - a) % p).cast("int")))), " ")

    # the words are bound to a lambda's variable, so that they are taken once and not for every word
    planted = F.transform(F.array(words), repeated)[0]
    hit = (h % 10 == 0) & F.col(text_col).rlike("[^\\x20\\x09-\\x0D]")
    return docs.withColumn(text_col, F.when(hit, planted).otherwise(F.col(text_col)))
