"""Small frames with everything that may go wrong in a table."""

from __future__ import annotations

import random

LONG = "lorem ipsum dolor " * 20_000


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def edge_docs(spark, extra: bool = True):
    """Nulls in every column, empty and very long texts, repeated rows, columns with awkward names."""
    rng = random.Random(4)
    plain = [words(rng, rng.randint(1, 120)) for _ in range(12)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(plain)]
    rows += [(20, None, "en", "s", 0), (21, "", "de", None, 0), (22, "   \n", None, "s", 4), (23, LONG, "en", "s", len(LONG))]
    rows += [(None, plain[0], None, None, None), (None, None, None, None, None), rows[3], rows[3], (24, plain[1], "de", "t", 1)]
    rows += [(25, "token = 'abcdef1234' 🙂 é 中文 call +1 (206) 555-0100", "fr", "s", 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("blob", "fp", "id", "ids", "shard", "slot", "leaks", "findings", "component", "y", "a.b", "lang_pred", "pii", "quality_score"):
            frame = frame.withColumn(name, frame.source)
    return frame


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
