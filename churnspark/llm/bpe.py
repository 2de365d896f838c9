"""BPE encoding by speculation: greedy longest match, vectorised pair checks, exact merging of failures."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from churnspark.llm.tables import add_columns, place

SUFFIX = "</w>"
NEVER = np.int64(1) << 40
#: Distinct words remembered by a worker; beyond it the memory starts afresh, results stay the same.
REMEMBERED = 500_000
#: White space as the tokenizer's own pattern understands it.
_SPACE = "\t-\r \x85\xa0  -     　"
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")

#: Texts of ASCII and accented Latin letters alone are composed already and split by a faster pattern.
_LATIN = re.compile("[\t-\r -~À-ÖØ-öø-ſ]*").fullmatch
_LATIN_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ſ]+").findall
#: Words up to this many characters are merged by scanning, longer ones with a heap.
_SHORT = 40


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_LETTERS = byte_letters()


def pieces(text: str) -> list[str]:
    """Words of a text without added tokens: NFC, lower case per character, split, white space dropped."""
    if _LATIN(text):
        return _LATIN_PIECES(text.lower())
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    # lower() alone would turn a capital sigma at a word's end into the final form
    return _PIECES.findall(text.replace("Σ", "σ").lower())


@dataclass
class Vocabulary:
    """Token texts and merges of a word-end BPE file; about 50,000 entries whatever the data."""

    texts: list[str]
    left: np.ndarray
    right: np.ndarray
    rank: np.ndarray  # of the merge that makes the token, -1 for single characters
    added: dict[str, int]

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        ids = whole["model"]["vocab"]
        added = {t["content"]: t["id"] for t in whole["added_tokens"]}
        texts = [""] * (1 + max([*ids.values(), *added.values()]))
        for text, k in (ids | added).items():
            texts[k] = text
        left = np.full(len(texts), -1, np.int64)
        right, rank = left.copy(), left.copy()
        for r, (a, b) in enumerate(whole["model"]["merges"]):
            k = ids[a + b]
            if rank[k] >= 0:
                raise ValueError("two merges make one token: the pair check does not hold for this file")
            left[k], right[k], rank[k] = ids[a], ids[b], r
        made = rank >= 0
        if (rank[left[made]] >= rank[made]).any() or (rank[right[made]] >= rank[made]).any():
            raise ValueError("a merge comes before its parts: the pair check does not hold for this file")
        return cls(texts, left, right, rank, added)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {t: k for k, t in enumerate(self.texts) if t not in self.added}

    @cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        made = np.flatnonzero(self.rank >= 0)
        return {
            (a, b): (r, k)
            for a, b, r, k in zip(self.left[made].tolist(), self.right[made].tolist(), self.rank[made].tolist(), made.tolist())
        }

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        made = np.flatnonzero(self.rank >= 0)
        keys = self.left[made] * len(self.texts) + self.right[made]
        order = np.argsort(keys)
        return keys[order], self.rank[made][order]

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, ranks = self._pairs
        wanted = a * len(self.texts) + b
        at = np.searchsorted(keys, wanted).clip(0, len(keys) - 1)
        return np.where(keys[at] == wanted, ranks[at], NEVER)

    def stands(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether the border between tokens a and b survives all merges before `until`.

        Goes back in time: of the two pieces at the border the one made last is undone, which
        gives the pair that stood there before, and how long it stood. The border falls if that
        pair's own merge comes sooner. Of equal merges the left one is done first.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        limit = np.full(len(a), NEVER) if until is None else np.array(until, np.int64)
        fine = self.pair_rank(a, b) >= limit
        active = np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            fx, fy = self.rank[x], self.rank[y]
            active, x, y, fx, fy = (v[fine[active] & ((fx >= 0) | (fy >= 0))] for v in (active, x, y, fx, fy))
            undo_left = fx > fy
            x = np.where(undo_left, self.right[x], x)
            y = np.where(undo_left, y, self.left[y])
            cross = self.pair_rank(x, y)
            fine[active] = np.where(undo_left, cross >= fx, cross > fy)
            a[active], b[active] = x, y
        return fine

    @cached_property
    def reachable(self) -> dict[str, int]:
        """Tokens that are the encoding of their own text; only these may be proposed."""
        made = np.flatnonzero(self.rank >= 0)
        ok = np.ones(len(self.texts), bool)
        ok[made] = self.stands(self.left[made], self.right[made], self.rank[made])
        for k in made[np.argsort(self.rank[made])].tolist():
            ok[k] &= ok[self.left[k]] and ok[self.right[k]]
        return {t: k for t, k in self.ids.items() if ok[k]}

    @cached_property
    def longest(self) -> dict[str, int]:
        """Length of the longest token by its first two characters."""
        out: dict[str, int] = {}
        for t in self.reachable:
            out[t[:2]] = max(len(t), out.get(t[:2], 1))
        return out

    def spell(self, word: str) -> str:
        if word.isascii() and word.isprintable() and " " not in word:
            return word
        return "".join(map(_LETTERS.__getitem__, word.encode("utf-8")))

    def propose(self, spelled: str) -> list[int]:
        """Longest match from the left; the last character carries the word end."""
        whole, out, at, get, longest = spelled + SUFFIX, [], 0, self.reachable.get, self.longest.get
        last = len(spelled) - 1
        while at < last:
            most = longest(whole[at:at + 2], 1)
            if len(whole) - at <= most and (token := get(whole[at:])) is not None:
                out.append(token)
                return out
            # short of the word end a token must leave the last character for another one
            for size in range(min(most, last - at), 0, -1):
                token = get(whole[at:at + size])
                if token is not None:
                    out.append(token)
                    at += size
                    break
            else:
                raise KeyError(whole[at:])
        return [*out, self.reachable[whole[last:]]]

    def merge(self, spelled: str) -> list[int]:
        """Exact merging: lowest rank first, then leftmost; long words by a heap over a linked list."""
        ids = [self.ids[c] for c in spelled[:-1]] + [self.ids[spelled[-1] + SUFFIX]]
        if len(ids) <= _SHORT:
            return self._scan(ids)
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        get = self.merges.get
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, m[1], ids[p], ids[q]))
        return [k for k in ids if k >= 0]

    def _scan(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (int(NEVER), -1)
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is none:
                break
            k = found.index(best)
            ids[k:k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Proposals for all words, one vectorised check of all borders, exact merging where it fails."""
        spelled = [self.spell(w) for w in words]
        proposed = [self.propose(s) for s in spelled]
        flat = np.fromiter(chain.from_iterable(proposed), np.int64)
        word_of = np.repeat(np.arange(len(words)), [len(p) for p in proposed])
        inner = np.flatnonzero(word_of[1:] == word_of[:-1])
        bad = inner[~self.stands(flat[inner], flat[inner + 1])]
        for w in np.unique(word_of[bad]).tolist():
            proposed[w] = self.merge(spelled[w])
        return proposed


class Encoder:
    """Encodes texts with a memory of words; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        added = vocabulary.added
        self.split = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._forget()

    def _forget(self) -> None:
        """Word k has tokens flat[start[k]:start[k] + size[k]]."""
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        added = self.vocabulary.added
        plain = [w for w in words if w not in added]
        special = [w for w in words if w in added]
        tokens = self.vocabulary.encode_words(plain) + [[added[w]] for w in special]
        size = np.array([len(t) for t in tokens], np.int64)
        self.number.update(zip(plain + special, range(len(self.number), len(self.number) + len(tokens))))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(tokens), np.int32, int(size.sum()))))

    def _words(self, text: str) -> list[str]:
        found = self.split and self.split.search(text)
        if not found:
            return pieces(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            # an added token keeps its own text, which no ordinary word has
            out += [*pieces(text[at:m.start()]), m.group()]
            at = m.end()
        return out + pieces(text[at:])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text begins and the last one ends."""
        if len(self.number) > REMEMBERED:
            self._forget()
        split = [self._words(t or "") for t in texts]
        if new := list(set(chain.from_iterable(split)) - self.number.keys()):
            self._learn(new)
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64)
        size = self.size[words]
        ends = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.start[words] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[at], ends[np.concatenate(([0], np.cumsum([len(w) for w in split]))).astype(np.int64)]


_ready: dict[str, Encoder] = {}


def encoder(shared: Broadcast) -> Encoder:
    key, vocabulary = shared.value
    if key not in _ready:
        _ready[key] = Encoder(vocabulary)
    return _ready[key]


def share(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary read once on the driver; its size is the file's, not the data's."""
    return spark.sparkContext.broadcast((path, Vocabulary.read(path)))


def encode(docs: DataFrame, path: str, text_col: str = "text", decoded: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of `docs`, token ids, and with `decoded` a column of the ids' decoded text.

    The file's normaliser (NFC, lower case), split and added tokens are honoured. Defined
    cases: a null or empty text, or one of white space only, has no ids; repeated texts are
    encoded alike; texts and words of any length are encoded whole; an empty table gives an
    empty result; a column already called like a result is replaced.
    """
    shared = share(docs.sparkSession, path)
    new = {ids_col: "array<int>"} | ({decoded: "string"} if decoded else {})
    at = place(docs, text_col, *new)

    def run(batch: pa.RecordBatch) -> list:
        tool = encoder(shared)
        ids, bounds = tool.encode(batch.column(at).to_pylist())
        out = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids))]
        return out + ([pa.array(decode_ids(tool.vocabulary, ids, bounds), pa.string())] if decoded else [])

    return add_columns(docs, run, **new)


def decode(frame: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; null ids decode to null, ids out of range raise an error."""
    shared = share(frame.sparkSession, path)
    at = place(frame, ids_col, text_col)

    def run(batch: pa.RecordBatch) -> list:
        vocabulary, lists = encoder(shared).vocabulary, batch.column(at)
        bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
        texts = decode_ids(vocabulary, lists.flatten().to_numpy(), bounds)
        return [pa.array([t if there else None for t, there in zip(texts, lists.is_valid().to_pylist())], pa.string())]

    return add_columns(frame, run, **{text_col: "string"})


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The file names no decoder, so tokens are joined by a space as they stand."""
    tokens = list(map(vocabulary.texts.__getitem__, ids.tolist()))
    edges = bounds.tolist()
    return [" ".join(tokens[a:b]) for a, b in zip(edges, edges[1:])]
