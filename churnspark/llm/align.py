"""Alignment of two tokenizers over the same bytes by diagonal run skipping, and corpus-wide counts of linked tokens."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from churnspark.llm import piece
from churnspark.llm.bpe import byte_letters
from churnspark.llm.tables import add_columns, place, slices
from churnspark.llm.words import Memory
from churnspark.session import stage

#: Links of small groups made at a time, and how many links a group has at most to be small.
LINKS_AT_ONCE, SMALL = 2_000_000, 65_536
#: Entries whose bytes are written at a time.
WRITTEN_AT_ONCE = 65_536
#: Pairs of ids (and bytes of text, four as one pair) of the documents that share one look-up; a longer document is alone.
BUNDLE = 2_000_000
#: Pairs in one row of a bundle's list.
LISTED = 20_000
#: White space that the byte tokenizer's pattern may join with a space behind it.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_CHUNKS = re.compile("[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+").findall
#: How files of the byte-level format cut texts; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BORDERS = re.compile("(?<=\\S)(?=[ \t\n\r])").split


#: Letters, digits and spaces below this are the same in every version of Unicode a library may have been built with.
_LATIN = re.compile("[\x00-\u024f]*").fullmatch


def _row(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text begins and the last one ends."""
    bounds = np.concatenate(([0], np.cumsum([len(ids) for ids in lists]))).astype(np.int64)
    return (np.concatenate([np.asarray(ids, np.int64) for ids in lists]) if lists else np.empty(0, np.int64)), bounds


class Bytes:
    """A byte-level BPE file and the bytes of each entry.

    Texts of Latin letters are encoded by the faster of two libraries, whose ranks are the file's own ids;
    all others by the library of the file's format, chunk by chunk and remembered.
    """

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_str(text)
        self.tool.encode_special_tokens = True
        whole = json.loads(text)
        pre, model = whole["pre_tokenizer"] or {}, whole["model"]
        if whole["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("only byte-level files without a normaliser or a prefix are read")
        back = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        entries = {entry: k for entry, k in model["vocab"].items() if entry not in added}
        self.surface = [b""] * (1 + max([*entries.values(), *added.values()]))
        for entry, k in entries.items():
            self.surface[k] = bytes(map(back.__getitem__, entry))
        for entry, k in added.items():
            self.surface[k] = entry.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [entries[a + b] for a, b in merges]
        self.memory = Memory(self._chunks)
        self.fast = None
        if made == sorted(set(made)) and len(made) + 256 == len(entries):
            ranks = {self.surface[k]: k for k in entries.values()}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _chunks(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """No match of the format's pattern goes on with white space after another character, so texts can be cut there."""
        plain = [bool(self.fast and _LATIN(t)) for t in texts]
        rest = [t for t, p in zip(texts, plain) if not p]
        ids, at = self.memory.encode([_BORDERS(t) if _ODD_SPACE(t) else _CHUNKS(t) for t in rest])
        others = iter([ids[p:q] for p, q in zip(at.tolist(), at[1:].tolist())])
        return _row([self.fast.encode_to_numpy(t, disallowed_special=()) if p else next(others) for t, p in zip(texts, plain)])


class Pieces:
    """A merge-type piece model: encoding by its library, and the bytes of each piece."""

    def __init__(self, data: bytes):
        from sentencepiece import SentencePieceProcessor

        self.tool = SentencePieceProcessor(model_proto=data)
        self.surface = piece.Model.parse(data).surface

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return _row(self.tool.encode([t or "" for t in texts], num_threads=1))


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of either side lie before each offset at which tokens of both sides end.

    `a` and `b` are rising end offsets with the same last one. At the current shift between the
    indexes of the two sides the end arrays are compared in windows that double while they are
    equal and halve once they are not: a stretch of one-to-one tokens is jumped in logarithmically many comparisons.
    Behind it the side that ends first moves on until both end together, which makes the new shift.
    """
    # a last end that no end of the other side equals stops every comparison
    a, b = np.append(a, -1), np.append(b, -2)
    width = a.itemsize
    in_a, in_b, ends_a, ends_b = a.tobytes(), b.tobytes(), a.tolist(), b.tolist()
    n, i, j = len(ends_a) - 1, 0, 0
    begins: list[int] = []  # of a stretch of shared ends: index in a, index in b, length
    while i < n:
        x, y = ends_a[i], ends_b[j]
        while x != y:
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        p, q = i + 1, j + 1
        if ends_a[p] == ends_b[q]:  # a window of one
            p += 1
            q += 1
            step = 2
            while in_a[p * width:(p + step) * width] == in_b[q * width:(q + step) * width]:
                p += step
                q += step
                step *= 2
            while step > 2:
                step //= 2
                if in_a[p * width:(p + step) * width] == in_b[q * width:(q + step) * width]:
                    p += step
                    q += step
            if ends_a[p] == ends_b[q]:
                p += 1
                q += 1
        begins += (i, j, p - i)
        i, j = p, q
    first_a, first_b, length = np.array(begins, np.int64).reshape(-1, 3).T
    inside = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + 1
    return np.repeat(first_a, length) + inside, np.repeat(first_b, length) + inside


def _within(firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each first on, `lengths` of them."""
    return np.repeat(firsts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


class Spelling:
    """The bytes of numbered entries, to be written one after another."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entries), np.uint8)

    def write(self, numbers: np.ndarray) -> np.ndarray:
        out, at = np.empty(int(self.size[numbers].sum()), np.uint8), 0
        for p in range(0, len(numbers), WRITTEN_AT_ONCE):
            part = numbers[p:p + WRITTEN_AT_ONCE]
            spot = _within(self.first[part], self.size[part])
            self.flat.take(spot, out=out[at:at + len(spot)], mode="clip")
            at += len(spot)
        return out


class Aligned:
    """Tokens of both sides of a batch of texts, and the groups they fall into.

    Texts that are null or empty, or whose tokens do not give back the bytes, have no tokens here.
    """

    def __init__(self, tools: Tools, texts: list[str | None]):
        self.tools = tools
        spaced = [" " + t if t else "" for t in texts]
        raw = [t.encode("utf-8") for t in spaced]
        a, a_at = tools.a.encode(spaced)
        b, b_at = tools.b.encode(texts)
        fine = self._gives(raw, tools.spelled_a, a, a_at) & self._gives(raw, tools.spelled_b, b, b_at)
        self.a, self.n_a = self._only(a, np.diff(a_at), fine)
        self.b, self.n_b = self._only(b, np.diff(b_at), fine)
        self.end_a, self.end_b = shared_ends(np.cumsum(tools.spelled_a.size[self.a]), np.cumsum(tools.spelled_b.size[self.b]))
        self.in_a = np.diff(self.end_a, prepend=0)  # tokens in each group
        self.in_b = np.diff(self.end_b, prepend=0)
        bounds = np.searchsorted(self.end_a, np.concatenate(([0], np.cumsum(self.n_a))), side="right")
        bounds[0] = 0
        self.group_at = bounds
        self.n_groups = np.diff(bounds)

    @staticmethod
    def _gives(raw: list[bytes], spelled: Spelling, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text give back its bytes."""
        ends = np.concatenate(([0], np.cumsum(spelled.size[ids])))[at].tolist()
        got = memoryview(spelled.write(ids))
        return np.array([got[p:q] == want for p, q, want in zip(ends, ends[1:], raw)], bool)

    @staticmethod
    def _only(ids: np.ndarray, sizes: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids if fine.all() else ids[np.repeat(fine, sizes)], np.where(fine, sizes, 0)

    @cached_property
    def n_links(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.in_a * self.in_b)))
        return total[self.group_at[1:]] - total[self.group_at[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked pairs of ids of each text: the pairs, how many links each has, and where each text begins."""
        tools = self.tools
        text_of = np.repeat(np.arange(len(self.n_a)), self.n_groups)
        links = self.in_a * self.in_b
        keys, times = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        small = np.flatnonzero(links <= SMALL)
        block = np.cumsum(links[small]) // LINKS_AT_ONCE
        for part in np.split(small, np.flatnonzero(np.diff(block)) + 1) if len(small) else []:
            group = np.repeat(part, links[part])
            k = _within(np.zeros(len(part), np.int64), links[part])
            left = self.a[self.end_a[group] - self.in_a[group] + k // self.in_b[group]]
            right = self.b[self.end_b[group] - self.in_b[group] + k % self.in_b[group]]
            found, many = np.unique((text_of[group] * tools.pairs) + left * tools.n_b + right, return_counts=True)
            keys.append(found)
            times.append(many)
        for g in np.flatnonzero(links > SMALL).tolist():
            left, n_left = np.unique(self.a[self.end_a[g] - self.in_a[g]:self.end_a[g]], return_counts=True)
            right, n_right = np.unique(self.b[self.end_b[g] - self.in_b[g]:self.end_b[g]], return_counts=True)
            keys.append((text_of[g] * tools.pairs + left[:, None] * tools.n_b + right).ravel())
            times.append((n_left[:, None] * n_right).ravel())
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        many = np.zeros(len(found), np.int64)
        np.add.at(many, at, np.concatenate(times))
        return found % tools.pairs, many, np.searchsorted(found, np.arange(len(self.n_a) + 1) * tools.pairs)

    def listed(self) -> list[bytes]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`, in ASCII."""
        a_first, b_first = self.end_a - self.in_a, self.end_b - self.in_b
        n_a, n_b = self.tools.n_a, self.tools.n_b
        # a token's own comma, or the mark behind the last one of a group's side
        a = self.a.copy()
        a[self.end_a - 1] += n_a
        b = self.b + 2 * n_a
        b[self.end_b - 1] += n_b
        out = np.empty(len(a) + len(b), np.int64)
        out[_within(a_first + b_first, self.in_a)] = a
        out[_within(self.end_a + b_first, self.in_b)] = b
        marks = self.tools.marks
        edges = np.concatenate(([0], np.cumsum(marks.size[out])))[np.concatenate(([0], np.cumsum(self.n_a + self.n_b)))].tolist()
        text = marks.write(out).tobytes()
        return [text[p:max(p, q - 1)] for p, q in zip(edges, edges[1:])]


class Tools:
    """Both tokenizers of a worker."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = Bytes(a), Pieces(b)
        self.spelled_a, self.spelled_b = Spelling(self.a.surface), Spelling(self.b.surface)
        self.n_a, self.n_b = len(self.a.surface), len(self.b.surface)
        self.pairs = self.n_a * self.n_b

    @cached_property
    def marks(self) -> Spelling:
        return Spelling([b"%d%c" % (k, mark) for n, marks in ((self.n_a, b",|"), (self.n_b, b",;")) for mark in marks for k in range(n)])


_ready: dict[tuple[str, str], Tools] = {}


def _tools(shared: Broadcast) -> Tools:
    key, a, b = shared.value
    if key not in _ready:
        _ready[key] = Tools(a, b)
    return _ready[key]


def _share(docs: DataFrame, a_path: str, b_path: str) -> tuple[Broadcast, int, int]:
    """Both files read once on the driver, and how many ids each has; their size does not depend on the data."""
    with open(a_path, encoding="utf-8") as file:
        a = file.read()
    with open(b_path, "rb") as file:
        b = file.read()
    return docs.sparkSession.sparkContext.broadcast(((a_path, b_path), a, b)), len(Bytes(a).surface), len(Pieces(b).surface)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds).astype(np.int32)), pa.array(values, kind))


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, the token ids of both sides (a_ids, b_ids) and how many of each lie in every group (a_sizes, b_sizes).

    A encodes a space and the text by a byte-level BPE file, B the text by a merge-type piece model that
    puts the space itself; neither adds special tokens, and their strings in a text are plain text.
    Groups end at the byte offsets where tokens of both sides end. Defined cases: as `link_counts`, without tokens all lists are empty.
    """
    shared, _, _ = _share(docs, a_path, b_path)
    new = {"a_ids": "array<int>", "b_ids": "array<int>", "a_sizes": "array<int>", "b_sizes": "array<int>"}
    at = place(docs, text_col, *new)

    def run(batch: pa.RecordBatch) -> list:
        found = Aligned(_tools(shared), batch.column(at).to_pylist())
        token_a, token_b = (np.concatenate(([0], np.cumsum(n))) for n in (found.n_a, found.n_b))
        return [
            _lists(found.a, token_a, pa.int32()), _lists(found.b, token_b, pa.int32()),
            _lists(found.in_a, found.group_at, pa.int32()), _lists(found.in_b, found.group_at, pa.int32()),
        ]

    return add_columns(docs, run, **new)


#: What link_counts adds to every document.
ADDED = {
    "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups": "string",
}


def link_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", hashed: bool = False) -> DataFrame:
    """All columns of `docs` and, over the links of A and B tokens in one group, how common each pair of ids is in all documents.

    n_a, n_b, n_groups, n_links; a pair's count is the number of documents with such a link: count_sum is
    its sum over a document's links, n_best how many links have the highest count of their A id, ties
    included; groups lists `a1,a2|b1;a3|b2,b3`, or with `hashed` the SHA-256 of that in hex.

    Documents are read and aligned once and written with their distinct pairs. Those of a bundle
    (documents that follow each other in a partition, up to a fixed number of pairs) are counted before anything is
    shuffled; the counts of all bundles are added up, and each bundle gets back the counts of its own pairs,
    so neither a common pair nor a common text makes a large task, and no table of all pairs is held anywhere.
    Defined cases: a null or empty text, or one whose tokens do not give back its bytes (U+2581 is read as a
    space by B), has zeros and an empty text for groups; texts of any length are aligned whole; repeated rows
    count as documents each; an empty table gives an empty result; columns already called like a result are
    replaced, all others, whatever their names, stay.
    """
    shared, n_a, n_b = _share(docs, a_path, b_path)
    kept = docs.drop(*ADDED)
    at, width = place(docs, text_col, *ADDED), len(kept.columns)
    number = T.IntegerType() if n_a * n_b < 2**31 else T.LongType()
    arrow = pa.int32() if n_a * n_b < 2**31 else pa.int64()
    plain = [f"c{k}" for k in range(width)]
    figures = ["n_a", "n_b", "n_groups", "n_links"]
    fields = [T.StructField(name, f.dataType) for name, f in zip(plain, kept.schema.fields)]
    fields += [T.StructField(name, T.LongType()) for name in figures] + [T.StructField("groups", T.StringType())]
    fields += [T.StructField(n, T.ArrayType(t)) for n, t in (("pairs", number), ("times", T.IntegerType()), ("listed", number), ("rows", T.LongType()))]
    schema = T.StructType([*fields, T.StructField("bundle", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, weight, met = TaskContext.get().partitionId() << 32, 0, []
        types: list[pa.DataType] = []

        def summary() -> Iterator[pa.RecordBatch]:
            """The pairs of the bundle and how many documents hold each, as rows without a document."""
            found, at_ = np.unique(np.concatenate(met), return_inverse=True)
            rows = np.bincount(at_, minlength=len(found))
            size = -(-len(found) // LISTED)
            edges = np.minimum(np.arange(size + 1) * LISTED, len(found))
            empty = [pa.nulls(size, t) for t in types]
            yield pa.RecordBatch.from_arrays(
                [*empty, _lists(found, edges, arrow), _lists(rows, edges, pa.int64()), pa.array(np.full(size, bundle))], names=schema.names,
            )

        for batch in slices(batches):
            found = Aligned(_tools(shared), batch.column(at).to_pylist())
            pairs, times, bounds = found.pairs()
            groups = found.listed()
            if hashed:
                groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            out = [
                *batch.columns, *(pa.array(v) for v in (found.n_a, found.n_b, found.n_groups, found.n_links)), pa.array(groups, pa.string() if hashed else pa.binary()).cast(pa.string()),
                _lists(pairs, bounds, arrow), _lists(times, bounds, pa.int32()),
            ]
            types = [c.type for c in out]
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*out, pa.nulls(size, pa.list_(arrow)), pa.nulls(size, pa.list_(pa.int64())), pa.array(np.full(size, bundle))], names=schema.names,
            )
            met.append(pairs)
            weight += len(pairs) + batch.nbytes // 4
            if weight >= BUNDLE:
                yield from summary()
                bundle, weight, met = bundle + 1, 0, []
        if met:
            yield from summary()

    written = stage(kept.toDF(*plain).mapInArrow(run, schema), "alignment")
    mine = written.where(F.col("listed").isNotNull()).select(F.col("bundle").alias("owner"), F.explode(F.arrays_zip("listed", "rows")).alias("one"))
    mine = mine.select("owner", F.col("one.listed").alias("pair"), F.col("one.rows").alias("rows"))
    counted = mine.groupBy("pair").agg(F.sum("rows").alias("count"))
    left = F.floor(F.col("pair") / n_b)
    # an A id has at most as many pairs as B has ids
    top = counted.groupBy(left.alias("left")).agg(F.max("count").alias("top"))
    counted = counted.withColumn("left", left).join(top, "left").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    looked_up = mine.select("owner", "pair").join(counted, "pair")
    documents = written.where(F.col("listed").isNull()).drop("listed", "rows")
    result = T.StructType([
        *kept.schema.fields, *(T.StructField(n, T.StringType() if t == "string" else T.LongType()) for n, t in ADDED.items()),
    ])

    def score(held: pa.Table, counts: pa.Table) -> pa.Table:
        pair = counts.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, count, best = pair[order], counts.column("count").to_numpy()[order], counts.column("best").to_numpy()[order]
        pairs, times = (held.column(c).combine_chunks() for c in ("pairs", "times"))
        ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy()))).astype(np.int64)
        spot = np.searchsorted(pair, pairs.flatten().to_numpy())
        many = times.flatten().to_numpy().astype(np.int64)
        sums = [np.concatenate(([0], np.cumsum(v))) for v in (many * best[spot], many * count[spot])] if len(pair) else [ends * 0] * 2
        n_best, count_sum = (pa.array((s[ends[1:]] - s[ends[:-1]]).astype(np.int64)) for s in sums)
        columns = [held.column(c) for c in [*plain, *figures]] + [n_best, count_sum, held.column("groups")]
        return pa.Table.from_arrays(columns, names=[f"r{k}" for k in range(len(columns))])

    named = T.StructType([T.StructField(f"r{k}", f.dataType) for k, f in enumerate(result.fields)])
    scored = documents.groupBy("bundle").cogroup(looked_up.groupBy("owner")).applyInArrow(score, named)
    return scored.toDF(*result.names)
