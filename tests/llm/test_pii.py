import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from frames import edge_docs, no_docs

from churnspark.llm import pii, queries
from churnspark.llm.tables import table

KEY = pii.Permutation(b"key")
TEXT = (
    "Mail ann.lee@mail2.example.com, +1 (017) 555-7713 or 4929348385146306; 97.51.17.173. ssn 123-45-6789, "
    "DE89 3704 0044 0532 0130 00 on 1999-12-31, 31.12.1999 and 12/31/1999."
)


@pytest.mark.parametrize("size", [1, 2, 7, 100, 1000, 4097])
def test_permutes_any_range(size):
    images = [KEY.forward(k, size, "t") for k in range(size)]
    assert sorted(images) == list(range(size))
    assert [KEY.backward(k, size, "t") for k in images] == list(range(size))


def test_round_trip_and_kinds():
    clean, found = pii.rewrite(TEXT, KEY.forward)
    assert [k for k, _, _ in found] == ["email", "phone", "card", "ip", "ssn", "iban", "date", "date", "date"]
    assert pii.rewrite(clean, KEY.backward)[0] == TEXT
    values = [TEXT[a:b] for _, a, b in found]
    assert not any(v in clean for v in values)
    shapes = [[re.sub(r"\d+", "9", x) for x in re.findall(r"[\d./()-]{3,}", t)] for t in (clean, TEXT)]
    assert shapes[0] == shapes[1]
    again = pii.find(clean)
    assert [k for k, _, _ in again] == [k for k, _, _ in found]  # pseudonyms validate as the same kinds


def test_equal_values_stay_linked():
    texts = ["call +1 206 555 0100 now", "tel. +1 (206) 555-0100", "on 2001-02-03", "am 03.02.2001"]
    clean = [pii.rewrite(t, KEY.forward)[0] for t in texts]
    digits = [re.sub(r"\D", "", c) for c in clean]
    assert digits[0] == digits[1]
    assert re.search(r"(\d{4})-(\d\d)-(\d\d)", clean[2]).groups()[::-1] == re.search(r"(\d\d)\.(\d\d)\.(\d{4})", clean[3]).groups()
    assert pii.rewrite("a ann@x.org", KEY.forward)[0][2:] == pii.rewrite("b Ann@x.org", KEY.forward)[0][2:]
    assert pii.rewrite(TEXT, pii.Permutation(b"other").forward)[0] != pii.rewrite(TEXT, KEY.forward)[0]


@pytest.mark.parametrize("text", [
    "1234567890123456", "v1.2.3.4.5", "300.1.2.3", "1999-13-31", "31.02.1999", "0000000000000000", "a@b", "@", "x@@y.z", "page 12 of 300",
    "DE88 3704 0044 0532 0130 00", "000-12-3456", "", None, "10,000 rows", "2024", "3.14159265358979"])
def test_what_does_not_validate_stays(text):
    assert pii.rewrite(text, KEY.forward) == (text, [])


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = pii.pseudonymise(docs, b"key").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.clean_text, [tuple(p) for p in r.pii]) == pii.rewrite(r.text, KEY.forward)
    assert sum(len(r.pii) for r in rows) == 1
    assert pii.pseudonymise(no_docs(spark), b"key").collect() == []


def test_query_leaves_clean_texts_alone(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    key = pii.Permutation(queries.PII_KEY)
    rows = queries.op10_pii(spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_found for r in rows) > 0
    for r in rows:
        assert pii.rewrite(r.text, key.backward)[0].lower() == texts[r.doc_id].lower()
        if not r.n_found:
            assert r.text == texts[r.doc_id]
            assert not re.search(r"[\w.]+@[\w.]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}", r.text)


CARD, IBAN, PHONE = "4929348385146306", "BE68 5390 0754 7034", "+1 (826) 555-4081"


@pytest.mark.parametrize("text, values", [
    ("Des +1 (826) 555-4081 190.137.223.204 du", [PHONE, "190.137.223.204"]),
    ("un. +1 (843) 555-7672 170.106.47.218 Et", ["+1 (843) 555-7672", "170.106.47.218"]),
    (f"{PHONE} 190 137 22", [PHONE]), (f"{PHONE} {PHONE}", [PHONE, PHONE]), (f"{PHONE} {CARD}", [PHONE, CARD]),
    (f"{CARD} 97 rows", [CARD]), (f"12 {CARD}", [CARD]), (f"12-{CARD}-7", [CARD]), ("4929 3483 8514 6306 97 12", ["4929 3483 8514 6306"]),
    (f"{CARD} {CARD}", [CARD, CARD]), (f"{CARD} 97.51.17.173", [CARD, "97.51.17.173"]), (f"{CARD} 123-45-6789", [CARD, "123-45-6789"]),
    (f"{IBAN} 1234 5678", [IBAN]), (f"{IBAN} EUR", [IBAN]), (f"AB12 CD34 {IBAN}", [IBAN]), (f"{IBAN} 4929 3483 8514 6306", [IBAN, "4929 3483 8514 6306"]),
    ("+44 20 7946 0958 1234 5670", ["+44 20 7946 0958"]), ("1999 206-555-0100 2000 2001", ["206-555-0100"]),
])
def test_values_next_to_other_digits(text, values):
    clean, found = pii.rewrite(text, KEY.forward)
    covered = [k for _, a, b in found for k in range(a, b)]
    at = 0
    for v in values:
        at = text.index(v, at)
        assert set(range(at, at + len(v))) <= set(covered), (v, found)
        at += len(v)
    assert not any(v in clean for v in values)
    assert pii.rewrite(clean, KEY.backward)[0] == text


def test_no_number_is_left_in_any_text(spark, sf):
    """Places of the formats in the given tables, whatever else a text holds."""
    formats = re.compile(r"[\w.]+@[\w.]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}")
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(
        spark.createDataFrame([(-1, f"a {PHONE} 190.137.223.204 b")], "doc_id long, text string"))
    for r in pii.pseudonymise(docs, b"key").collect():
        for m in formats.finditer(r.text or ""):
            assert any(p.start <= m.start() and m.end() <= p.end for p in r.pii), (r.doc_id, m.group())


DIGITS = {"arabic": "٠١٢٣٤٥٦٧٨٩", "fullwidth": "０１２３４５６７８９", "superscript": "⁰¹²³⁴⁵⁶⁷⁸⁹"}
VALUES = [
    "id 900-12-3456", "666-12-3456", "000-12-3456", "123-45-6789", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "192.168.0.1",
    "4111111111111111", "4111 1111 1111 1111", "2020-02-03", "3/4/2021", "+1 (206) 555-0100", "206-555-0100", "a9@b.com",
]


@pytest.mark.parametrize("script", DIGITS)
@pytest.mark.parametrize("value", VALUES)
def test_digits_of_other_scripts_stay(script, value):
    """All or some digits of another script: no error, and what is replaced keeps its format."""
    step = pii.Permutation(b"key").forward
    foreign = str.maketrans("0123456789", DIGITS[script])
    for text in (value.translate(foreign), value[:-3] + value[-3:].translate(foreign), value[:5].translate(foreign) + value[5:]):
        clean, found = pii.rewrite(text, step)
        assert len(clean) == len(text)
        for a, b in zip(text, clean):
            assert (a in "0123456789") == (b in "0123456789") and (a.isdigit() and a not in "0123456789") <= (a == b)


def test_digits_of_other_scripts_through_spark(spark):
    rows = spark.createDataFrame([("id ٩٠٠-12-3456",), ("٦٦٦-12-3456",), ("٠٠٠-12-3456",), ("DE٨٩370400440532013000",)], "text string")
    assert [r.clean_text for r in pii.pseudonymise(rows, b"key").collect()] == [r.text for r in rows.collect()]
