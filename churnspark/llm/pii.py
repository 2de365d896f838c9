"""Personal data replaced by pseudonyms of the same format: keyed Feistel permutations."""

from __future__ import annotations

import datetime
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from churnspark.llm.tables import add_columns, place

ROUNDS = 10
SPAN = "array<struct<kind:string,start:int,end:int>>"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Permutation:
    """A keyed permutation of 0 .. size - 1 for any size: Feistel over two digits, walked into range."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()
        self.forward = lru_cache(maxsize=100_000)(self._forward)

    def _round(self, k: int, tweak: str, half: int, modulus: int) -> int:
        data = f"{k}|{tweak}|{modulus}|{half}".encode()
        width = modulus.bit_length() // 8 + 9  # so many bytes that the remainder is even
        out = b"".join(blake2b(data + b"|%d" % i, key=self.key, digest_size=64).digest() for i in range(-(-width // 64)))
        return int.from_bytes(out[:width], "big") % modulus

    @staticmethod
    def _sides(size: int) -> tuple[int, int]:
        a = math.isqrt(size - 1) + 1 if size > 1 else 1
        return a, -(-size // a)

    def _forward(self, value: int, size: int, tweak: str) -> int:
        a, b = self._sides(size)
        while True:
            left, right = value % a, value // a
            for k in range(ROUNDS):
                if k % 2:
                    right = (right + self._round(k, tweak, left, b)) % b
                else:
                    left = (left + self._round(k, tweak, right, a)) % a
            value = right * a + left
            if value < size:
                return value

    def backward(self, value: int, size: int, tweak: str) -> int:
        a, b = self._sides(size)
        while True:
            left, right = value % a, value // a
            for k in reversed(range(ROUNDS)):
                if k % 2:
                    right = (right - self._round(k, tweak, left, b)) % b
                else:
                    left = (left - self._round(k, tweak, right, a)) % a
            value = right * a + left
            if value < size:
                return value


Step = Callable[[int, int, str], int]

#: The digits a format may have; those of other scripts belong to none.
DIGITS = frozenset("0123456789")


def _characters(text: str, step: Step, tweak: str) -> str:
    """Digits stay digits, letters keep their case, everything else its place."""
    bases = [(48, 10) if c in DIGITS else (97, 26) if c.islower() else (65, 26) if c.isupper() else None for c in text]
    value, size = 0, 1
    for c, base in zip(text, bases):
        if base:
            value, size = value * base[1] + ord(c) - base[0], size * base[1]
    value = step(value, size, f"{tweak}|{''.join('d' if b and b[1] == 10 else 'a' if b else '.' for b in bases)}")
    out = list(text)
    for k in range(len(text) - 1, -1, -1):
        if bases[k]:
            value, digit = divmod(value, bases[k][1])
            out[k] = chr(bases[k][0] + digit)
    return "".join(out)


def _put_digits(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def luhn(digits: str) -> int:
    """Remainder of the check sum: zero for a valid number."""
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _email(text: str, step: Step) -> str:
    """Local part and host change, the top-level domain stays; case does not tell addresses apart."""
    head, dot, top = text.lower().rpartition(".")
    return _characters(head, step, "email") + dot + top


def _card(text: str, step: Step) -> str:
    digits = _digits_of(text)
    inner = digits[1:-1]
    body = digits[0] + str(step(int(inner), 10 ** len(inner), f"card{len(digits)}")).zfill(len(inner))
    return _put_digits(text, body + str(-luhn(body + "0") % 10))


def _phone(text: str, step: Step) -> str:
    """The country code stays; the rest is permuted as one number, however it is written."""
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head, rest = (code.group(), text[code.end():]) if code else ("", text)
    digits = _digits_of(rest)
    return head + _put_digits(rest, str(step(int(digits), 10 ** len(digits), f"phone{len(digits)}")).zfill(len(digits)))


def _address(text: str, step: Step) -> str:
    value = int.from_bytes(bytes(map(int, text.split("."))), "big")
    return ".".join(map(str, step(value, 1 << 32, "ip").to_bytes(4, "big")))


_AREAS = [a for a in range(1, 900) if a != 666]


def _social(text: str, step: Step) -> str:
    area, group, serial = map(int, text.split("-"))
    size = len(_AREAS) * 99 * 9999
    value = step((_AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, size, "ssn")
    rest, serial = divmod(value, 9999)
    area, group = divmod(rest, 99)
    return f"{_AREAS[area]:03}-{group + 1:02}-{serial + 1:04}"


def _iban_rest(country: str, check: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + check)) % 97


def _iban(text: str, step: Step) -> str:
    packed = text.replace(" ", "")
    account = _characters(packed[4:], step, "iban" + packed[:2])
    packed = packed[:2] + f"{98 - _iban_rest(packed[:2], '00', account):02}" + account
    rest = iter(packed)
    return "".join(c if c == " " else next(rest) for c in text)


def _as_date(text: str) -> tuple[datetime.date, str] | None:
    """The date and how it is written; day before month unless only the other way is a date."""
    parts, mark = re.split(r"[-/.]", text), re.search(r"[-/.]", text).group()
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy") if mark != "/" else ("mdy", "dmy")
    for order in orders:
        y, m, d = (int(parts[order.index(c)]) for c in "ymd")
        try:
            day = datetime.date(y, m, d)
        except ValueError:
            continue
        if FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return day, order
    return None


def _date(text: str, step: Step) -> str:
    """Dates are permuted as days, so one date written in two ways keeps one pseudonym."""
    day, order = _as_date(text)
    moved = datetime.date.fromordinal(FIRST_DAY + step(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
    mark = re.search(r"[-/.]", text).group()
    values = {"y": f"{moved.year:04}", "m": f"{moved.month:02}", "d": f"{moved.day:02}"}
    return mark.join(values[c] for c in order)


@dataclass(frozen=True)
class Kind:
    """A format. `inside`: where the longest match does not validate, parts of it at group borders may.

    A part ends where `after` matches.
    """

    name: str
    pattern: re.Pattern
    valid: Callable[[str], bool]
    replace: Callable[[str, Step], str]
    inside: bool = False
    after: re.Pattern = re.compile(r"(?!\w)")


def _valid_phone(text: str) -> bool:
    digits = _digits_of(text)
    if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", text):
        return False  # a social security number that did not validate
    return 9 <= len(digits) <= 15 and (text[0] in "+(" or len(re.findall(r"[0-9][ .-]+(?=[0-9])", text)) >= 2)


def _valid_card(text: str) -> bool:
    digits = _digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits) == 0 and len(set(digits)) > 1


#: Length of an IBAN by country.
_IBAN_LENGTHS = {
    country: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items() for country in countries.split()
}


def _valid_iban(text: str) -> bool:
    packed = text.replace(" ", "")
    return 15 <= len(packed) <= 34 and _iban_rest(packed[:2], packed[2:4], packed[4:]) == 1


def _country_length(text: str) -> bool:
    return len(text.replace(" ", "")) == _IBAN_LENGTHS.get(text[:2]) and _valid_iban(text)


_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AFTER_IBAN, _AFTER_CARD = re.compile(r"(?![A-Za-z0-9])"), re.compile(r"(?!\w|\.[0-9])")
_BEFORE_CARD = r"(?:(?<=[0-9]-)|(?<![\w+-]))(?<![0-9]\.)"

#: In order of precedence: a place belongs to the first kind that takes it. A kind that can be told by
#: its grouping or its country's length goes before the same kind without.
KINDS = (
    Kind("iban", _IBAN, _country_length, _iban, True, _AFTER_IBAN),
    Kind("iban", _IBAN, _valid_iban, _iban),
    Kind("iban", _IBAN, lambda t: t[:2] not in _IBAN_LENGTHS and _valid_iban(t), _iban, True, _AFTER_IBAN),
    Kind("ip", re.compile(r"(?<!\w)(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])"),
         lambda t: all(int(p) < 256 for p in t.split(".")), _address),
    Kind("card", re.compile(_BEFORE_CARD + r"(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})(?!\w|\.[0-9])"),
         _valid_card, _card, True, _AFTER_CARD),
    Kind("ssn", re.compile(r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])"), lambda t: True, _social),
    Kind("date", re.compile(r"(?<![\w/-])(?<![0-9]\.)(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![\w/-]|\.[0-9])"),
         lambda t: _as_date(t) is not None, _date),
    Kind("phone", re.compile(r"(?:(?<![+\w])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})|(?<!\w)\([0-9]{3}\))[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?!\w)"), _valid_phone, _phone),
    Kind("card", re.compile(_BEFORE_CARD + r"[0-9](?:[ -]?[0-9]){12,18}(?!\w|\.[0-9])"), _valid_card, _card, True, _AFTER_CARD),
    Kind("phone", re.compile(r"(?:(?<![+[0-9]])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})|(?<!\w)\([0-9]{2,4}\))(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)"),
         _valid_phone, _phone, True),
    Kind("phone", re.compile(r"(?<![\w.-])[0-9]{2,4}(?:[.-][0-9]{2,4}){2,4}(?!\w|[.-][0-9])"), _valid_phone, _phone),
    # groups apart by blanks alone do not say where a number ends: the whole stretch or nothing
    Kind("phone", re.compile(r"(?:(?<![+[0-9]])\+[0-9]{1,3}[ .-]?|(?<!\w)(?<![0-9]\.))(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\w)"), _valid_phone, _phone),
)
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_LOCAL = re.compile(r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*\Z")
_SOME_DIGIT = re.compile(r"[0-9]").search


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around every @; the local part has 64 characters at most, as the format says."""
    at, end = text.find("@"), 0
    while at >= 0:
        host, local = _HOST.match(text, at + 1), _LOCAL.search(text[max(end, at - 64):at])
        if host and local:
            yield at - len(local.group()), host.end()
            end = host.end()
        at = text.find("@", max(at + 1, end))


def _part(kind: Kind, text: str, m: re.Match) -> int | None:
    """The end of the longest valid part of a match that starts where it does, None without any."""
    a, b = m.span()
    if kind.valid(m.group()):
        return b
    for e in range(b - 1, a, -1) if kind.inside else ():
        if text[e - 1].isalnum() and kind.after.match(text, e) and kind.pattern.fullmatch(text, a, e) and kind.valid(text[a:e]):
            return e
    return None


def _free(text: str, found: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """The stretches between the places found that hold a digit."""
    at = 0
    for _, a, b in [*sorted(found, key=lambda f: f[1]), ("", len(text), len(text))]:
        if a > at and _SOME_DIGIT(text, at, a):
            yield at, a
        at = b


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all validated places, none overlapping, in order of place.

    A kind searches the stretches between the places already taken. Where its longest match does not
    validate, the shorter ones at group borders are tried, then those that start later.
    """
    text = text or ""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    free = list(_free(text, found))
    for kind in KINDS if free else ():
        taken = []
        for a, b in free:
            piece, at = text[a:b], 0
            while m := kind.pattern.search(piece, at):
                end = _part(kind, piece, m)
                if end is None:
                    at = m.start() + 1 if kind.inside else m.end()
                else:
                    taken.append((kind.name, a + m.start(), a + end))
                    at = end
        if taken:
            found += taken
            free = list(_free(text, found))
    return sorted(found, key=lambda f: f[1])


_REPLACE = {kind.name: kind.replace for kind in KINDS} | {"email": _email}


def rewrite(text: str | None, step: Step) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with every place replaced, and the places in the old text."""
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], _REPLACE[kind](text[a:b], step)]
        at = b
    return "".join([*out, text[at:]]), found


_ready: dict[bytes, Permutation] = {}


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", clean_col: str = "clean_text") -> DataFrame:
    """`docs` with `clean_col` and `pii`, the kinds and places found in the whole text.

    E-mail addresses, IBANs (check number), cards (Luhn), social security numbers, IP addresses,
    telephone numbers and calendar dates are validated and mapped by a permutation keyed with
    `key` within their format, check digits made anew. Equal values get equal pseudonyms in
    all documents; the holder of the key can go back. Numbers that do not validate are left alone.

    Defined cases: a null text stays null, an empty one empty, both without places; repeated
    rows come back as often and alike; texts of any length are searched whole; a place that several kinds
    could take goes to the first of KINDS, of equal starts the longest valid match; digits other than 0 to 9
    are no digits of any format and stay; an empty table gives an empty result; input columns of the
    results' names are replaced.
    """
    at = place(docs, text_col, clean_col, "pii")

    def run(batch: pa.RecordBatch) -> list:
        if key not in _ready:
            _ready[key] = Permutation(key)
        done = [rewrite(t, _ready[key].forward) for t in batch.column(at).to_pylist()]
        places = [[{"kind": k, "start": a, "end": b} for k, a, b in found] for _, found in done]
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        return [pa.array([t for t, _ in done], pa.string()), pa.array(places, pa.list_(kind))]

    return add_columns(docs, run, **{clean_col: "string", "pii": SPAN})
