"""Main text of web pages by a recurrent block labeller trained on made-up layouts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.llm import recurrent
from churnspark.llm.blocks import Block, Element, parse
from churnspark.llm.layouts import MAIN, Layouts
from churnspark.llm.tables import add_columns, place, slices

PATH_BUCKETS, WORD_BUCKETS = 512, 512
PATH_SIZE, WORD_SIZE, HIDDEN = 24, 8, 20
#: Words of about this many pages, chosen by a hash of the page, are the pool the made-up pages draw from.
FIT_PAGES = 200
LAYOUTS, EPOCHS, BATCH, RATE = 1500, 5, 32, 0.01
#: Share of the words shown in training.
WORDS_SEEN = 0.4
SEED = 5


@dataclass
class Rows:
    """Blocks of several pages in a row: hashed names of the tag path, hashed words, and numbers."""

    path: np.ndarray        # entries of the names an element adds to its path: element * PATH_BUCKETS + bucket
    last: np.ndarray        # entries of the last two names once more: row * PATH_BUCKETS + bucket
    above: np.ndarray       # the element above each element, elements by depth; itself at the top
    levels: np.ndarray      # where each depth starts among the elements, and their number
    inside: np.ndarray      # the element of each row, -1 for none
    word: np.ndarray        # entries: row * WORD_BUCKETS + bucket
    numbers: np.ndarray
    sizes: np.ndarray       # blocks of each page


_hashed: dict[str, int] = {}


def _hash(word: str) -> int:
    found = _hashed.get(word)
    if found is None:
        if len(_hashed) > 300_000:
            _hashed.clear()
        found = _hashed[word] = crc32(word.encode("utf-8", "replace"))
    return found


def rows_of(pages: list[list[Block]]) -> Rows:
    blocks = [b for p in pages for b in p]
    # every element once, though many blocks stand inside it
    seen: dict[int, Element] = {}
    for b in blocks:
        at = b.element
        while at and id(at) not in seen:
            seen[id(at)] = at
            at = at.above
    elements = sorted(seen.values(), key=lambda e: e.depth)
    number = {id(e): k for k, e in enumerate(elements)}
    depths = np.array([e.depth for e in elements], np.int64)
    path = [k * PATH_BUCKETS + _hash(n) % PATH_BUCKETS for k, e in enumerate(elements) for n in e.new]
    last = [k * PATH_BUCKETS + _hash("last " + n) % PATH_BUCKETS for k, b in enumerate(blocks) if b.element for n in b.element.last]
    words = [b.text.split() for b in blocks]
    word = [k * WORD_BUCKETS + _hash(w) % WORD_BUCKETS for k, ws in enumerate(words) for w in dict.fromkeys(ws)]  # a repeated word says no more
    length = np.array([len(b.text) for b in blocks], np.float64)
    linked = np.array([b.linked for b in blocks], np.float64)
    return Rows(
        np.array(path, np.int64), np.array(last, np.int64),
        np.array([number[id(e.above)] if e.above else k for k, e in enumerate(elements)], np.int64),
        np.concatenate(([0], np.flatnonzero(np.diff(depths)) + 1, [len(depths)])) if elements else np.zeros(1, np.int64),
        np.array([number[id(b.element)] if b.element else -1 for b in blocks], np.int64),
        np.array(word, np.int64),
        np.stack([np.log1p(length) / 5, np.minimum(1, linked / np.maximum(1, length)), np.ones(len(blocks))], axis=1).reshape(-1, 3),
        np.array([len(p) for p in pages], np.int64),
    )


def _sums(entries: np.ndarray, rows: int, buckets: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weight rows of each row's entries, without a dense table, and their number."""
    order = np.argsort(entries // buckets, kind="stable")
    entries = entries[order]
    counts = np.bincount(entries // buckets, minlength=rows)
    out = np.zeros((rows, weights.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(weights[entries % buckets], starts, axis=0)
    return out, counts


def _scale(counts: np.ndarray) -> np.ndarray:
    return 1 / np.sqrt(np.maximum(1, counts))[:, None]


def _spread(entries: np.ndarray, buckets: int, d: np.ndarray) -> np.ndarray:
    """Gradient of the weights from the gradient of the sums."""
    each = d[entries // buckets]
    return np.stack([np.bincount(entries % buckets, each[:, k], buckets) for k in range(d.shape[1])], axis=1)


def _word_bags(rows: Rows, weights: np.ndarray) -> np.ndarray:
    sums, counts = _sums(rows.word, len(rows.numbers), WORD_BUCKETS, weights)
    return sums * _scale(counts)


def _word_gradient(rows: Rows, d: np.ndarray) -> np.ndarray:
    counts = np.bincount(rows.word // WORD_BUCKETS, minlength=len(rows.numbers))
    return _spread(rows.word, WORD_BUCKETS, d * _scale(counts))


def _path_counts(rows: Rows, own: np.ndarray) -> np.ndarray:
    """Distinct names on the path of each row and its last two."""
    whole = _down(rows, own.astype(float)[:, None])[:, 0]
    return np.where(rows.inside >= 0, whole[rows.inside] if len(whole) else 0, 0) + np.bincount(
        rows.last // PATH_BUCKETS, minlength=len(rows.numbers)
    )


def _down(rows: Rows, own: np.ndarray) -> np.ndarray:
    """Of each element, the sum over itself and all above it: one step per depth, whatever stands inside."""
    total = own.copy()
    for at, end in zip(rows.levels[1:-1], rows.levels[2:]):
        total[at:end] += total[rows.above[at:end]]
    return total


def _path_bags(rows: Rows, weights: np.ndarray) -> np.ndarray:
    """Sum of the distinct names of each row's path and of the last two once more, over the root of their number."""
    own, added = _sums(rows.path, len(rows.above), PATH_BUCKETS, weights)
    out, _ = _sums(rows.last, len(rows.numbers), PATH_BUCKETS, weights)
    held = rows.inside >= 0
    out[held] += _down(rows, own)[rows.inside[held]]
    return out * _scale(_path_counts(rows, added))


def _path_gradient(rows: Rows, d: np.ndarray) -> np.ndarray:
    added = np.bincount(rows.path // PATH_BUCKETS, minlength=len(rows.above))
    d = d * _scale(_path_counts(rows, added))
    of_element = np.zeros((len(rows.above), d.shape[1]))
    held = rows.inside >= 0
    np.add.at(of_element, rows.inside[held], d[held])
    for at, end in reversed(list(zip(rows.levels[1:-1], rows.levels[2:]))):
        np.add.at(of_element, rows.above[at:end], of_element[at:end])
    return _spread(rows.path, PATH_BUCKETS, of_element) + _spread(rows.last, PATH_BUCKETS, d)


class Labeller:
    """Block vectors, an LSTM in each direction over the blocks of a page, and a logistic label."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        width = PATH_SIZE + WORD_SIZE + 3
        small = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
        self.w = {
            "path": rng.standard_normal((PATH_BUCKETS, PATH_SIZE)) * 0.3, "word": rng.standard_normal((WORD_BUCKETS, WORD_SIZE)) * 0.05,
            "ax": small(width, 4 * HIDDEN), "ah": small(HIDDEN, 4 * HIDDEN), "ab": np.zeros(4 * HIDDEN),
            "bx": small(width, 4 * HIDDEN), "bh": small(HIDDEN, 4 * HIDDEN), "bb": np.zeros(4 * HIDDEN),
            "out": small(width + 2 * HIDDEN, 1), "bias": np.zeros(1),
        }

    def chances(self, rows: Rows, keep: bool = False):
        w = self.w
        x = np.concatenate((
            _path_bags(rows, w["path"]), _word_bags(rows, w["word"]), rows.numbers), axis=1)
        sizes = rows.sizes[rows.sizes > 0]
        ahead, behind = recurrent.steps(sizes, False), recurrent.steps(sizes, True)
        a, a_saved = recurrent.run(x, ahead, w["ax"], w["ah"], w["ab"], keep)
        b, b_saved = recurrent.run(x, behind, w["bx"], w["bh"], w["bb"], keep)
        top = np.concatenate((x, a, b), axis=1)
        chance = 1 / (1 + np.exp(-(top @ w["out"] + w["bias"])[:, 0]))
        return (chance, x, top, ahead, behind, a_saved, b_saved) if keep else chance

    def learn(self, rows: Rows, main: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(rows.numbers)
        chance, x, top, ahead, behind, a_saved, b_saved = self.chances(rows, True)
        d = ((chance - main) / n)[:, None]
        d_top = d @ w["out"].T
        width = x.shape[1]
        dxa, dax, dah, dab = recurrent.gradients(x, ahead, w["ax"], w["ah"], a_saved, d_top[:, width:width + HIDDEN])
        dxb, dbx, dbh, dbb = recurrent.gradients(x, behind, w["bx"], w["bh"], b_saved, d_top[:, width + HIDDEN:])
        dx = d_top[:, :width] + dxa + dxb
        return {
            "path": _path_gradient(rows, dx[:, :PATH_SIZE]),
            "word": _word_gradient(rows, dx[:, PATH_SIZE:PATH_SIZE + WORD_SIZE]),
            "ax": dax, "ah": dah, "ab": dab, "bx": dbx, "bh": dbh, "bb": dbb, "out": top.T @ d, "bias": d.sum(axis=0),
        }

    def main_text(self, pages: list[str | None]) -> list[str]:
        """The main text of each page: its blocks labelled main, joined by one space."""
        parsed = [parse(p) for p in pages]
        if not any(parsed):
            return ["" for _ in pages]
        chosen = iter((self.chances(rows_of(parsed)) >= 0.5).tolist())
        return [" ".join([b.text for b in blocks if next(chosen)]) for blocks in parsed]


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a made-up page and which of them are main text."""
    blocks = parse(page)
    main = [MAIN in b.text for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MAIN, "")
    return blocks, main


def fit(words: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Labeller:
    """Train on `layouts` made-up pages whose text is drawn from `words`."""
    maker = Layouts(words, seed)
    pages = [labelled(maker.page()) for _ in range(layouts)]
    model = Labeller(seed)
    adam = recurrent.Adam(model.w, RATE)
    rng = np.random.default_rng(seed)
    for epoch in range(EPOCHS):
        adam.rate = RATE * (1 - epoch / EPOCHS) ** 0.5
        order = rng.permutation(len(pages))
        for at in range(0, len(order), BATCH):
            batch = [pages[k] for k in order[at:at + BATCH] if pages[k][0]]
            main = np.array([m for _, ms in batch for m in ms], np.float64)
            rows = rows_of([b for b, _ in batch])
            rows.word = rows.word[rng.random(len(rows.word)) < WORDS_SEEN]  # the path must do without the words
            adam.step(model.learn(rows, main))
    return model


def train(pages: DataFrame, html_col: str = "html", fit_pages: int = FIT_PAGES) -> Labeller:
    """A labeller whose word pool comes from about `fit_pages` of the pages, chosen by hash."""
    chosen = pages.select(F.col(html_col).cast("string").alias("html")).where("html is not null")
    share = min(1.0, fit_pages / max(1, chosen.count()))
    chosen = chosen.where(F.pmod(F.xxhash64("html", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            # some words of each page, evenly spread; the pool only colours the made-up pages
            texts = [" ".join(b.text for b in parse(p)).split() for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([ws[:: max(1, len(ws) // 100)] for ws in texts], pa.list_(pa.string()))], names=["words"])

    found = chosen.mapInArrow(run, "words array<string>").collect()
    return fit(sorted({w for r in found for w in r["words"]}))


def extract(pages: DataFrame, model: Labeller, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` with the main text of the whole page.

    Blocks are the runs of text between block borders in page order, with character references
    decoded and white space folded; an LSTM in each direction over all blocks of a page labels
    every one, and those labelled main are joined by one space. Defined cases: a null or empty page,
    or one without text, gives an empty text; text without markup is one block; pages and blocks
    of any length are read whole; repeated rows come back as often; an empty table gives an empty
    result; an input column called like the result is replaced.
    """
    at = place(pages, html_col, text_col)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array(shared.value.main_text(batch.column(at).to_pylist()), pa.string())]

    return add_columns(pages, run, **{text_col: "string"})
