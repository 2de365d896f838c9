"""Language of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.tables import add_columns, held_out, place, slices

#: About this many labelled documents of each language are fitted, chosen by a hash of their id.
FIT_DOCS = 400
#: Of each of them this many runs of RUN words, spread over the document.
RUNS, RUN = 8, 30
#: Runs of different documents are chained to sequences, so that changes of language are learned too.
CHAINED = 4
BUCKETS = 1 << 16
NGRAMS = (1, 2, 3, 4)
EPOCHS, BATCH, RATE = 6, 64, 0.3
NONE = "und"
#: Distinct words a worker remembers; beyond it the memory starts afresh, results stay the same.
REMEMBERED = 800_000
#: Words of a sequence that are stepped through; longer ones are cut and put together exactly.
SEGMENT = 64
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall
_PLAIN_WORDS = re.compile("[a-z]+").findall
_EDGE = 1  # a character no word has, put before and after each word


def words_of(text: str | None) -> list[str]:
    """Runs of letters and the marks on them, in lower case; numerals, also those written as letters, are no words."""
    lower = (text or "").lower()
    return _PLAIN_WORDS(lower) if lower.isascii() else _WORDS(lower)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words in a row, and where each word's begin.

    Character n-grams over the word with an edge mark at both ends (those with a mark are its
    affixes), and the word as a whole, which is the learned lexicon.
    """
    sizes = np.array([len(w) for w in words], np.int64) + 2
    mark = chr(_EDGE)
    codes = np.frombuffer("".join([mark + w + mark for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    keys, owners = [], []
    rolled = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            # rolled[i] covers the n characters from i
            rolled = rolled[: len(codes) - n + 1] * np.uint64(1_000_003) + codes[n - 1:]
            inside = owner[n - 1:] == owner[: len(codes) - n + 1]
            keys.append((rolled * np.uint64(4) + np.uint64(n - 1))[inside])
            owners.append(owner[: len(codes) - n + 1][inside])
        at = np.arange(len(codes)).astype(np.uint64) - np.repeat(np.cumsum(sizes) - sizes, sizes).astype(np.uint64)
        mixed = (codes + np.uint64(977)) * (at * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
        mixed ^= mixed >> np.uint64(29)
        starts = np.cumsum(sizes) - sizes
        whole = np.add.reduceat(mixed, starts) if len(words) else mixed
        keys.append(whole * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1 << 63))
        owners.append(np.arange(len(words)))
        key, own = np.concatenate(keys), np.concatenate(owners)
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x94D049BB133111EB)
        buckets = (key >> np.uint64(64 - 16)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(words))
    return buckets[order], np.concatenate(([0], np.cumsum(counts)))


@dataclass
class Field:
    """Weights of the emissions (BUCKETS x languages) and of the changes between languages."""

    languages: list[str]
    weights: np.ndarray
    changes: np.ndarray
    first: np.ndarray
    number: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None

    def emissions(self, buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Mean weight of each word's features; the mean keeps long words from shouting."""
        sizes = np.diff(bounds)
        return np.add.reduceat(self.weights[buckets], bounds[:-1], axis=0) / np.sqrt(sizes)[:, None]

    def look_up(self, words: list[str]) -> np.ndarray:
        """Emissions of words, remembered by word."""
        if self.table is None or len(self.number) > REMEMBERED:
            self.number, self.table = {}, np.empty((0, len(self.languages)))
        if new := list(set(words) - self.number.keys()):
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
            self.table = np.concatenate((self.table, self.emissions(*features(new))))
        return self.table[np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))]

    def marginals(self, emissions: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Chance of every language at every word of sequences of any length (at least one word).

        Forward-backward in three sweeps over segments of SEGMENT words, all at once: the
        products of the steps of each segment, the messages that enter it from both ends, and
        the messages inside. The result is that of one pass from word to word.
        """
        if not len(sizes):
            return np.empty_like(emissions)
        emit = np.exp(emissions - emissions.max(axis=1, keepdims=True))
        move = np.exp(self.changes - self.changes.max())
        opening = np.exp(self.first - self.first.max())
        k = emit.shape[1]
        parts = -(-sizes // SEGMENT)
        head = np.cumsum(parts) - parts  # first segment of each sequence
        rank = np.arange(parts.sum()) - np.repeat(head, parts)
        start = np.repeat(np.cumsum(sizes) - sizes, parts) + rank * SEGMENT
        size = np.minimum(SEGMENT, np.repeat(sizes, parts) - rank * SEGMENT)
        ahead, back = _messages(emit, move, opening, parts, head, start, size, k)
        order = np.argsort(-size, kind="stable")
        forward, backward = np.empty_like(emit), np.empty_like(emit)
        alive = np.searchsorted(-size[order], -np.arange(1, size.max() + 1), side="right")
        state = ahead[order]
        for t, n in enumerate(alive):
            at = start[order[:n]] + t
            state = state[:n] if t == 0 else state[:n] @ move
            state = state * emit[at]
            state /= state.sum(axis=1, keepdims=True)
            forward[at] = state
        state = back[order].copy()
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            at = start[order[:n]] + t
            backward[at] = state[:n]
            step = (state[:n] * emit[at]) @ move.T
            state[:n] = step / step.sum(axis=1, keepdims=True)
        both = forward * backward
        return both / both.sum(axis=1, keepdims=True)


def _messages(emit, move, opening, parts, head, start, size, k) -> tuple[np.ndarray, np.ndarray]:
    """Forward message onto the first word of every segment and backward message onto its last.

    The forward one already holds the change into the segment; the product of a segment is
    that of its emissions and the changes between its words.
    """
    ahead = np.broadcast_to(opening, (len(size), k)).copy()
    back = np.ones((len(size), k))
    many = np.flatnonzero(parts > 1)
    if not len(many):
        return ahead, back
    mine = np.concatenate([np.arange(head[d], head[d] + parts[d]) for d in many])
    order = mine[np.argsort(-size[mine], kind="stable")]
    alive = np.searchsorted(-size[order], -np.arange(1, SEGMENT + 1), side="right")
    product = np.zeros((len(size), k, k))
    state = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
    for t, n in enumerate(alive):
        if not n:
            break
        inner = state[:n] if t == 0 else state[:n] @ move
        inner = inner * emit[start[order[:n]] + t][:, None, :]
        state[:n] = inner / inner.max(axis=(1, 2), keepdims=True)
    product[order] = state
    many = many[np.argsort(-parts[many], kind="stable")]
    alive = np.searchsorted(-parts[many], -np.arange(1, parts[many[0]] + 1), side="right")
    for r in range(1, len(alive)):
        at = head[many[:alive[r]]] + r
        message = (ahead[at - 1][:, None, :] @ product[at - 1])[:, 0] @ move
        ahead[at] = message / message.sum(axis=1, keepdims=True)
    for r in range(len(alive) - 1, 0, -1):
        at = head[many[:alive[r]]] + r
        message = (product[at] @ back[at][:, :, None])[:, :, 0] @ move.T
        back[at - 1] = message / message.sum(axis=1, keepdims=True)
    return ahead, back


def forward_backward(emissions: np.ndarray, sizes: np.ndarray, changes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of words, expected changes, and marginals of first words; sizes are at least one.

    Sequences step together, longest first, so a step touches only those still running.
    """
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    starts, longest = starts[order], sizes[order]
    running = np.searchsorted(-longest, -np.arange(1, longest[0] + 1), side="right") if len(sizes) else np.zeros(0, np.int64)
    emit = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    move = np.exp(changes - changes.max())
    ahead, back = np.empty_like(emit), np.empty_like(emit)
    state = np.exp(first - first.max())[None, :] * emit[starts]
    for t, n in enumerate(running):
        at = starts[:n] + t
        if t:
            state = (state[:n] @ move) * emit[at]
        state = state / state.sum(axis=1, keepdims=True)
        ahead[at] = state
    expected = np.zeros_like(move)
    state = np.empty((0, emit.shape[1]))
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        later = np.ones((n, emit.shape[1]))
        if len(state):
            m = len(state)
            gone = state * emit[at[:m] + 1]
            pair = ahead[at[:m]][:, :, None] * move[None] * gone[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            later[:m] = gone @ move.T
        state = later / later.sum(axis=1, keepdims=True)
        back[at] = state
    both = ahead * back
    both /= both.sum(axis=1, keepdims=True)
    return both, expected, both[starts]


def fit(runs: list[list[str]], labels: list[int], languages: list[str], seed: int = 3) -> Field:
    """Gradient ascent on the likelihood of chained runs; AdaGrad steps over mini-batches."""
    k = len(languages)
    model = Field(languages, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    numbers = {w: n for n, w in enumerate(dict.fromkeys(chain.from_iterable(runs)))}
    buckets, bounds = features(list(numbers))
    ids = [np.array([numbers[w] for w in r]) for r in runs]
    sums = [np.full(a.shape, 1e-6) for a in (model.weights, model.changes, model.first)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        sequences = [order[i:i + CHAINED] for i in range(0, len(order), CHAINED)]
        for at in range(0, len(sequences), BATCH):
            batch = sequences[at:at + BATCH]
            words = np.concatenate([ids[r] for s in batch for r in s])
            gold = np.concatenate([np.full(len(ids[r]), labels[r]) for s in batch for r in s])
            sizes = np.array([sum(len(ids[r]) for r in s) for s in batch])
            used, back = np.unique(words, return_inverse=True)
            spans = np.diff(bounds)[used]
            mine = buckets[np.repeat(bounds[used] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
            edges = np.concatenate(([0], np.cumsum(spans)))
            emissions = model.emissions(mine, edges)[back]
            both, expected, opening = forward_backward(emissions, sizes, model.changes, model.first)
            error = -both
            error[np.arange(len(gold)), gold] += 1
            per_word = np.stack([np.bincount(back, error[:, c], len(used)) for c in range(k)], axis=1) / np.sqrt(spans)[:, None]
            spread = np.repeat(per_word, spans, axis=0)
            grad = np.stack([np.bincount(mine, spread[:, c], BUCKETS) for c in range(k)], axis=1)
            starts = np.cumsum(sizes) - sizes
            inner = np.ones(len(gold), bool)
            inner[starts] = False
            follow = np.flatnonzero(inner)
            seen = np.bincount(gold[follow - 1] * k + gold[follow], minlength=k * k).reshape(k, k)
            gradients = (
                grad - 1e-3 * model.weights, seen - expected - 1e-2 * model.changes,
                np.bincount(gold[starts], minlength=k) - opening.sum(axis=0) - 1e-2 * model.first,
            )
            for weights, total, g in zip((model.weights, model.changes, model.first), sums, gradients):
                total += g * g
                weights += RATE * g / np.sqrt(total)
    return model


def _spread(words: list[str]) -> list[list[str]]:
    """At most RUNS runs of RUN words, evenly spread over all words."""
    pieces = [words[i:i + RUN] for i in range(0, len(words), RUN)]
    return [pieces[i] for i in sorted({k * len(pieces) // RUNS for k in range(RUNS)})] if pieces else []


def train(docs: DataFrame, docs_per_language: int = FIT_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fit on texts with a language that are not held out; about `docs_per_language` of each, by hash of id and text."""
    known = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(counts)
    if not languages:
        return fit([], [], [])
    share = F.create_map(*[F.lit(x) for c in languages for x in (c, int((1 << 30) * min(1.0, docs_per_language / counts[c])))])
    chosen = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")]).select("id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            runs = [[" ".join(r) for r in _spread(words_of(t))] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), batch.column(1), pa.array(runs, pa.list_(pa.string()))], names=["id", "lang", "runs"]
            )

    found = chosen.mapInArrow(run, "id string, lang string, runs array<string>").collect()
    rows = sorted((r["id"], r["lang"], line) for r in found for line in r["runs"])  # not the order of arrival
    return fit([line.split(" ") for _, _, line in rows], [languages.index(c) for _, c, _ in rows], languages)


def label_words(model: Field, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
    """For each text its words and, for each word, the chance of each language."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split])
    full = sizes > 0
    if not full.any() or not model.languages:
        return [(w, np.zeros((len(w), len(model.languages)))) for w in split]
    both = model.marginals(model.look_up(list(chain.from_iterable(split))), sizes[full])
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return [(w, both[a:b]) for w, a, b in zip(split, edges, edges[1:])]


def predict(docs: DataFrame, model: Field, text_col: str = "text") -> DataFrame:
    """`docs` with `lang_pred`, `lang_score` and `lang_words`, the share of words of each language.

    Every word of the whole text is labelled with the chances of forward-backward; the text has
    the language with most letters by these chances, and their share is the score. Defined
    cases: a null text or one without a letter is `und` with score 0, and so is every text when
    no language was learned; equal shares go to the language first by name; repeated rows come
    back as often; an empty table gives an empty result; input columns of those names are replaced.
    """
    new = {"lang_pred": "string", "lang_score": "double", "lang_words": "map<string,double>"}
    at = place(docs, text_col, *new)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        crf = shared.value
        names, scores, shares = [], [], []
        for words, chances in label_words(crf, batch.column(at).to_pylist()):
            letters = np.fromiter(map(len, words), np.float64, len(words))
            total = letters @ chances if len(words) and crf.languages else np.zeros(0)
            share = total / letters.sum() if len(total) else total
            best = int(np.argmax(share.round(12))) if len(share) else -1
            names.append(crf.languages[best] if best >= 0 else NONE)
            scores.append(min(1.0, float(share[best])) if best >= 0 else 0.0)
            shares.append(list(zip(crf.languages, share.tolist())) if best >= 0 else [])
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))]

    return add_columns(docs, run, **new)
