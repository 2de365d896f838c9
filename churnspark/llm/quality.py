"""Quality of documents by boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from churnspark.llm.boosting import Trees, fit
from churnspark.llm.tables import add_columns, held_out, place, slices

#: About this many labelled rows are fitted, chosen by a hash of their id; the driver holds their statistics.
FIT_ROWS = 20_000
REJECT_BELOW = 0.7
STATISTICS = (
    "log_chars", "log_words", "log_lines", "word_length", "longest_word", "letters", "digits", "capitals", "blanks",
    "stops", "marks", "symbols", "bars", "beyond_ascii", "distinct_words", "top_word", "top_five", "same_next",
    "bare_words", "marked_words", "short_words", "distinct_lines", "line_length", "byte_entropy", "distinct_pairs",
)
_BYTE = np.arange(256)
_CLASSES = {
    "letters": ((_BYTE | 32) >= 97) & ((_BYTE | 32) <= 122) | (_BYTE >= 128),
    "digits": (_BYTE >= 48) & (_BYTE <= 57),
    "capitals": (_BYTE >= 65) & (_BYTE <= 90),
    "blanks": np.isin(_BYTE, [9, 10, 11, 12, 13, 32]),
    "stops": np.isin(_BYTE, list(b".!?")),
    "marks": np.isin(_BYTE, list(b",;:'\"()-")),
    "symbols": np.isin(_BYTE, list(b"#$%&*+/<=>@\\^_`{}~[]")),
    "bars": _BYTE == ord("|"),
    "beyond_ascii": _BYTE >= 128,
}


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a whole text; all zero without a character."""
    text = text or ""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    share = raw / raw.sum()
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    counted = Counter(words)
    top = [c for _, c in counted.most_common(5)] or [0]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    some = share[share > 0]
    found = {
        "log_chars": np.log1p(len(text)), "log_words": np.log1p(len(words)), "log_lines": np.log1p(len(lines)),
        "word_length": lengths.mean(), "longest_word": np.log1p(lengths.max()),
        "distinct_words": len(counted) / n, "top_word": top[0] / n, "top_five": sum(top) / n,
        "same_next": sum(map(str.__eq__, words, words[1:])) / n,
        "bare_words": sum(c for w, c in counted.items() if not any(map(str.isalpha, w))) / n,
        "marked_words": sum(c for w, c in counted.items() if not w[-1].isalnum()) / n,
        "short_words": float((lengths <= 3).mean()),
        "distinct_lines": len(set(lines)) / len(lines), "line_length": np.log1p(len(text) / len(lines)),
        "byte_entropy": float(-(some * np.log2(some)).sum()),
        "distinct_pairs": len(set(zip(words, words[1:]))) / n,
        **{name: share[chosen].sum() for name, chosen in _CLASSES.items()},
    }
    return [float(found[name]) for name in STATISTICS]


def _share(column: Column, share: float, seed: int) -> Column:
    """A fixed share of the rows by a hash of the column."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on labelled documents that are not held out: all of them, or about `rows` chosen by hash.

    Ids with labels of both kinds, null labels and null ids are left out.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
        .where("y = z").select("__id", "y")
    )
    chosen = known.where(_share(F.col("__id"), min(1.0, rows / max(1, known.count())), 11))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    # about `rows` pairs of numbers: bounded whatever the tables hold
    sample = texts.join(F.broadcast(chosen), "__id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    found = sample.mapInArrow(run, "y int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), np.float64).reshape(-1, len(STATISTICS))
    order = np.lexsort(x.T)  # the fit must not depend on the order rows arrive in
    return fit(x[order], found["y"].to_numpy(np.float64)[order])


def score(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with `quality_score` (0 to 1, higher: label 1 likelier) of every whole text.

    Labels, language, source and id are no inputs of a score. Defined cases: a null text scores as
    the empty one; equal texts score alike; repeated rows come back as often; without labels, or
    with one kind of label only, every score is the smoothed share of label 1 (0.5 without any); an
    empty table gives an empty result; an input column called quality_score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows, id_col, text_col))
    at = place(docs, text_col, "quality_score")

    def run(batch: pa.RecordBatch) -> list:
        x = np.array([statistics(t) for t in batch.column(at).to_pylist()]).reshape(-1, len(STATISTICS))
        return [pa.array(shared.value.score(x))]

    return add_columns(docs, run, quality_score="double")
