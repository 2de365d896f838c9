"""SentencePiece merge-type models: exact encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from churnspark.llm.tables import add_columns, place
from churnspark.llm.words import Memory

SPACE = "▁"
#: Kinds of pieces and of models, as the file format numbers them.
NORMAL, UNKNOWN, CONTROL, BYTE, MERGES = 1, 2, 3, 6, 2
#: Stretches up to this many symbols are merged by scanning, longer ones with a heap.
_SHORT = 40
#: Pairs of tokens whose compatibility a worker remembers; beyond it the memory starts afresh.
PAIRS = 1_000_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


@dataclass
class Model:
    """Pieces of a model file and what may be merged; some 10,000 entries whatever the data."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    unknown_surface: str = " ⁇ "

    @classmethod
    def read(cls, path: str) -> Model:
        with open(path, "rb") as file:
            return cls.parse(file.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        """The model of a file's bytes; an error where it asks for more than merging and byte fallback."""
        whole = list(_fields(data))
        texts, scores, kinds = [], [], []
        for k, piece in whole:
            if k == 1:
                entry = dict(_fields(piece))
                texts.append(entry[1].decode("utf-8"))
                scores.append(struct.unpack("<f", entry.get(2, b"\0\0\0\0"))[0])
                kinds.append(entry.get(3, NORMAL))
        trainer = dict(_fields(b"".join(v for k, v in whole if k == 2)))
        normal = dict(_fields(b"".join(v for k, v in whole if k == 3)))
        plain = not normal.get(2) and normal.get(3, 1) and not normal.get(4, 1) and normal.get(5, 1)
        if trainer.get(3, 1) != MERGES or not trainer.get(35, 0) or trainer.get(24, 0) or not plain:
            raise ValueError("only merge-type models with byte fallback, a dummy prefix and no other normalising are read")
        if set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("models with user-defined or unused pieces are not read")
        return cls(texts, scores, kinds, trainer.get(44, b" \xe2\x81\x87 ").decode("utf-8"))

    def __post_init__(self) -> None:
        self.ids = {t: k for k, (t, kind) in enumerate(zip(self.texts, self.kinds)) if kind == NORMAL}
        self.byte_ids = [0] * 256
        for k, (text, kind) in enumerate(zip(self.texts, self.kinds)):
            if kind == BYTE:
                self.byte_ids[int(text[1:-1], 16)] = k
        self.letters = {t for t in self.ids if len(t) == 1}
        if not self.letters.issuperset("".join(self.ids)):
            raise ValueError("a piece has a character that is no piece: unknown characters would not stop merges")
        # no piece goes on with a space after another character: texts can be cut there without changing a merge
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in self.ids)

    @cached_property
    def order(self) -> list[int]:
        """Place of a piece's merge among all; pieces of equal score share a place and are merged from the left."""
        place_ = {s: k for k, s in enumerate(sorted(set(self.scores), reverse=True))}
        return [place_[s] for s in self.scores]

    def merge(self, text: str) -> list[int]:
        """Exact merging of a text of known characters: best score first, then leftmost."""
        ids, order, texts = self.ids, self.order, self.texts
        tokens = [ids[c] for c in text]
        if len(tokens) <= _SHORT:
            while len(tokens) > 1:
                best = None
                for k in range(len(tokens) - 1):
                    made = ids.get(texts[tokens[k]] + texts[tokens[k + 1]])
                    if made is not None and (best is None or order[made] < best[0]):
                        best = (order[made], k, made)
                if best is None:
                    break
                tokens[best[1]:best[1] + 2] = [best[2]]
            return tokens
        after, before = [*range(1, len(tokens)), -1], [*range(-1, len(tokens) - 1)]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(p: int, q: int) -> None:
            made = ids.get(texts[tokens[p]] + texts[tokens[q]])
            if made is not None:
                heapq.heappush(heap, (order[made], p, made, tokens[p], tokens[q]))

        for k in range(len(tokens) - 1):
            offer(k, k + 1)
        while heap:
            _, p, made, a, b = heapq.heappop(heap)
            q = after[p]
            if tokens[p] != a or q < 0 or tokens[q] != b:
                continue
            tokens[p], tokens[q], after[p] = made, -1, after[q]
            if after[q] >= 0:
                before[after[q]] = p
                offer(p, after[q])
            if before[p] >= 0:
                offer(before[p], p)
        return [t for t in tokens if t >= 0]

    @cached_property
    def reachable(self) -> list[bool]:
        """Pieces that are the encoding of their own text; no other comes out of merging."""
        return [kind == NORMAL and self.merge(text) == [k] for k, (text, kind) in enumerate(zip(self.texts, self.kinds))]

    @cached_property
    def whole(self) -> dict[str, int]:
        """Reachable pieces by their text."""
        return {t: k for t, k in self.ids.items() if self.reachable[k]}

    @cached_property
    def beside(self) -> set[tuple[str, str]]:
        """Characters that stand side by side in some piece."""
        return {pair for t in self.ids for pair in zip(t, t[1:])}

    @cached_property
    def shorter(self) -> list[int]:
        """The longest reachable piece that a reachable piece begins with; -1 if none."""
        out = [-1] * len(self.texts)
        for k, text in enumerate(self.texts):
            if self.reachable[k]:
                heads = (self.whole.get(text[:n], -1) for n in range(len(text) - 1, 0, -1))
                out[k] = next((h for h in heads if h >= 0), -1)
        return out

    @cached_property
    def surface(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        made = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), CONTROL: lambda t: b"",
                UNKNOWN: lambda t: self.unknown_surface.encode(), BYTE: lambda t: bytes([int(t[1:-1], 16)])}
        return [made[kind](t) for t, kind in zip(self.texts, self.kinds)]

    def ready(self) -> Model:
        """The model with its tables made, for the executors."""
        return self if self.shorter and self.beside and self.surface else self


class Encoder:
    """Encodes texts with a memory of words; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self.matcher = ahocorasick.Automaton()
        for k, text in enumerate(model.texts):
            if model.reachable[k]:
                self.matcher.add_word(text, k)
        self.matcher.make_automaton()
        self.silent = {k for k, kind in enumerate(model.kinds) if kind == CONTROL}
        self.sizes = list(map(len, model.texts))
        self.pairs: dict[int, bool] = {}
        self.memory = Memory(lambda words: [self.word(w) for w in words])
        self._cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def compatible(self, a: int, b: int) -> bool:
        """Whether two tokens stay two when their text is merged anew."""
        key = a * len(self.sizes) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.model.merge(self.model.texts[a] + self.model.texts[b]) == [a, b]
        return known

    def known(self, text: str) -> list[int]:
        """Tokens of a text of known characters.

        Takes the longest match at each place; if it does not stand beside the token before it,
        shorter ones; if none does, the token before it is taken back and its place marked as
        failed. A text that begins with compatible tokens has no other encoding up to there, so a failed place
        is never on the way to the result and is not entered twice.
        """
        n, sizes, shorter, compatible = len(text), self.sizes, self.model.shorter, self.compatible
        longest = [-1] * n
        for end, token in self.matcher.iter(text):
            longest[end + 1 - sizes[token]] = token  # matches come by their end: the last one is the longest
        may = bytearray(b"\1") * (n + 1)
        tokens: list[int] = []
        at, token, last = 0, longest[0], -1
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if may[end] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at, last, token = end, token, longest[end] if end < n else -1
            elif tokens:
                may[at] = 0
                token = tokens.pop()
                at, last = at - sizes[token], tokens[-1] if tokens else -1
            else:
                raise ValueError("no sequence of tokens stands")
        return tokens

    def word(self, word: str) -> list[int]:
        """Tokens of any text in which spaces are marked already; unknown characters become bytes.

        It is cut between characters that stand together in no piece, as no merge goes over such a place.
        """
        beside, out, start = self.model.beside, [], 0
        cuts = [k for k, pair in enumerate(zip(word, word[1:]), 1) if pair not in beside]
        for end in [*cuts, len(word)]:
            part = word[start:end]
            start = end
            token = self.model.whole.get(part)
            if token is not None:
                out.append(token)
            elif len(part) == 1:
                out += [self.model.byte_ids[b] for b in part.encode("utf-8")]
            else:
                out += self.known(part)
        return out

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        whole = SPACE + text.replace(" ", SPACE)
        return self._cut(whole) if self.model.cut else [whole]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text begins and the last one ends."""
        return self.memory.encode([self.words(t) for t in texts])

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: the space that encoding put in front is taken away, bytes that are no UTF-8 become U+FFFD each."""
        kinds, surface = self.model.kinds, self.model.surface
        parts = [surface[k] for k in ids]
        for at, k in enumerate(ids):
            if kinds[k] == NORMAL:  # the dummy prefix is at the first piece that shows, if it begins with a space
                parts[at] = parts[at].removeprefix(b" ")
            if kinds[k] != CONTROL:
                break
        try:
            if self.silent.isdisjoint(ids):  # bytes on both sides of a piece without text do not make a character
                return b"".join(parts).decode("utf-8")
        except UnicodeDecodeError:
            pass
        return self._mended(ids, parts)

    def _mended(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], b""
        for k, part in zip([*ids, -1], [*parts, b""]):
            if k >= 0 and self.model.kinds[k] == BYTE:
                run += part
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode("utf-8"))
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("�")
                run = run[size:]
            out.append(part.decode("utf-8"))
        return "".join(out)


_ready: dict[str, Encoder] = {}


def encoder(shared: Broadcast) -> Encoder:
    key, model = shared.value
    if key not in _ready:
        _ready[key] = Encoder(model)
    return _ready[key]


def share(spark: SparkSession, path: str) -> Broadcast:
    """The model read once on the driver; its size is the file's, not the data's."""
    return spark.sparkContext.broadcast((path, Model.read(path).ready()))


def encode(docs: DataFrame, path: str, text_col: str = "text", decoded: str | None = None, ids_col: str = "ids") -> DataFrame:
    """All columns of `docs`, token ids without begin or end ids, and with `decoded` a column of the ids' decoded text.

    Defined cases: a null or empty text has no ids and decodes to an empty text; texts and words of any
    length are encoded whole; characters without a piece become bytes; pieces of equal score are
    merged from the left; repeated texts are encoded alike; an empty table gives an empty result; columns
    already called like a result are replaced, all others, whatever their names, stay.
    """
    shared = share(docs.sparkSession, path)
    new = {ids_col: "array<int>"} | ({decoded: "string"} if decoded else {})
    at = place(docs, text_col, *new)

    def run(batch: pa.RecordBatch) -> list:
        tool = encoder(shared)
        ids, bounds = tool.encode(batch.column(at).to_pylist())
        out = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids))]
        if decoded:
            edges, plain = bounds.tolist(), ids.tolist()
            out.append(pa.array([tool.decode(plain[a:b]) for a, b in zip(edges, edges[1:])], pa.string()))
        return out

    return add_columns(docs, run, **new)


def decode(frame: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; null ids decode to null, a null among them or one out of range raises an error."""
    shared = share(frame.sparkSession, path)
    at = place(frame, ids_col, text_col)

    def run(batch: pa.RecordBatch) -> list:
        tool = encoder(shared)
        top = len(tool.model.texts)
        lists = batch.column(at).to_pylist()
        if any(k is None or not 0 <= k < top for ids in lists if ids for k in ids):
            raise ValueError("an id is null or outside the model")
        return [pa.array([None if ids is None else tool.decode(ids) for ids in lists], pa.string())]

    return add_columns(frame, run, **{text_col: "string"})
