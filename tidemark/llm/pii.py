"""PII: format-preserving Feistel pseudonyms.

Validated values (Luhn-valid card numbers, IBANs, social security and telephone numbers, IP
addresses, calendar dates, e-mail names, assigned secrets) are found in the whole text and replaced by
a keyed permutation of themselves within their own format: a number stays a valid number of the same
length and punctuation, a date a date in the same notation. The permutation depends on the kind, the
canonical value and the key alone, so equal values stay linked across documents and notations, and
``reveal`` undoes it, to the letter, for whoever holds the key.

Edge cases: a null text stays null with no finds; values that fail validation are left alone; equal
texts give equal results, so repeated rows stay repeated; extra columns are ignored. One pass, no shuffle.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Symbols that are permuted as one number, and characters of a value up to which its pseudonym is remembered.
CHUNK, REMEMBERED = 64, 256
#: Days that dates are permuted among.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

#: What looks like a value that has digits, by kind; the first that is valid counts.
PATTERNS = [(k, re.compile(p)) for k, p in [
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("date", r"(?<![\w/.-])(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?:(?=[Tt]\d\d)|(?![\w/-]|\.\d))"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    ("card", r"(?<!\d)(?<!\d\.)(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{4}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?!\d)"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w)])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.+-])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-]|\.\d)"),
    ("phone", r"\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{1,4}){2,6}(?!\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
]]
#: Where any of them begins.
NUMBERS = re.compile("|".join(f"(?:{p.pattern})" for _, p in PATTERNS))
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+)@((?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")
SECRET = re.compile(r"""(?i)\b(?:api[_-]?key|access[_-]?key|secret|token|passwd|password)["']?\s*[:=]\s*["']?([A-Za-z0-9_\-]{8,})""")

FOUND = "array<struct<kind:string,start:int,end:int>>"


def feistel(value: int, size: int, key: bytes, tweak: str, undo: bool = False) -> int:
    """Keyed permutation of the integers below ``size``: a balanced Feistel network over the next even number of bits, walked until it falls below ``size``."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    person = hashlib.blake2b(f"{tweak}/{size}".encode(), digest_size=16).digest()
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            source = left if undo else right
            raw = b""
            block = 0
            while len(raw) < width:
                raw += hashlib.blake2b(source.to_bytes(width, "big") + bytes([r, block]), key=key, person=person).digest()
                block += 1
            mixed = int.from_bytes(raw[:width], "big") & mask
            left, right = (right ^ mixed, left) if undo else (right, left ^ mixed)
        value = left << half | right
        if value < size:
            return value


def _mixed(symbols: list[tuple[str, str]], key: bytes, tweak: str, undo: bool) -> str:
    """Permute a word whose i-th symbol is one of an alphabet of its own.

    Longer words than CHUNK symbols are permuted chunk by chunk, each with a tweak of its place and of all other chunks
    (a keyed sum of their digests), in two passes, so that every symbol depends on all; undone in the opposite order.
    """
    if len(symbols) <= CHUNK:
        return _permuted(symbols, key, tweak, undo)
    parts = [symbols[i : i + CHUNK] for i in range(0, len(symbols), CHUNK)]
    words = ["".join(c for c, _ in p) for p in parts]
    alphabets = [[a for _, a in p] for p in parts]
    digest = lambda i: int.from_bytes(hashlib.blake2b(f"{i}/{words[i]}".encode(), key=key, digest_size=16).digest(), "big")
    sums = [digest(i) for i in range(len(words))]
    total = sum(sums)
    steps = [(turn, i) for turn in range(2) for i in range(len(words))]
    for turn, i in reversed(steps) if undo else steps:
        others = (total - sums[i]) % (1 << 128)
        words[i] = _permuted(list(zip(words[i], alphabets[i], strict=True)), key, f"{tweak}/{len(symbols)}/{turn}/{i}/{others:x}", undo)
        total -= sums[i]
        sums[i] = digest(i)
        total += sums[i]
    return "".join(words)


def _permuted(symbols: list[tuple[str, str]], key: bytes, tweak: str, undo: bool) -> str:
    value = 0
    size = 1
    for symbol, alphabet in symbols:
        value = value * len(alphabet) + alphabet.index(symbol)
        size *= len(alphabet)
    value = feistel(value, size, key, tweak, undo)
    out = []
    for _, alphabet in reversed(symbols):
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


DIGITS, UPPER, LOWER, ALNUM = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _alphabet(symbol: str) -> str:
    return next((a for a in (DIGITS, UPPER, LOWER) if symbol in a), symbol)


def _refill(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def luhn_digit(body: str) -> str:
    """The digit that makes ``body`` a valid card number."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(found: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = _mixed([(c, DIGITS) for c in digits[:-1]], key, "card", undo)
    return _refill(found, body + luhn_digit(body))


def _ssn(found: str, key: bytes, undo: bool) -> str | None:
    area, group, serial = (int(x) for x in found.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    at = feistel(at, 898 * 99 * 9999, key, "ssn", undo)
    at, serial = divmod(at, 9999)
    area, group = divmod(at, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(found: str, key: bytes, undo: bool) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    return ".".join(map(str, feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", undo).to_bytes(4, "big")))


def _phone(found: str, key: bytes, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 10 <= len(digits) <= 15:
        return None
    if found[0] == "+" and digits[0] != "1":
        code = len(re.match(r"\+(\d{1,3}?)(?:\D|(?=\d{10}$)|$)", found + " ")[1]) if re.match(r"\+\d{1,3}\D", found) else 2
        own = digits[code:]
        return _refill(found, digits[:code] + _mixed([(c, DIGITS) for c in own], key, f"phone{digits[:code]}", undo))
    if len(digits) != 10 and digits[:-10] != "1":
        return None
    return _refill(found, digits[:-10] + _mixed([(c, DIGITS) for c in digits[-10:]], key, "phone1", undo))


def _iban(found: str, key: bytes, undo: bool) -> str | None:
    plain = found.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _mixed([(c, _alphabet(c)) for c in plain[4:]], key, f"iban{plain[:2]}", undo)
    new = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(new) for c in found)


def _date(found: str, key: bytes, undo: bool) -> str | None:
    mark = next(c for c in found if not c.isdigit())
    parts = found.split(mark)
    a, b, c = map(int, parts)
    if len(parts[0]) == 4:
        order, (y, m, d) = "ymd", (a, b, c)
    elif mark == "/" and a <= 12:
        order, (y, m, d) = "mdy", (c, a, b)
    elif b <= 12:
        order, (y, m, d) = "dmy", (c, b, a)
    else:
        order, (y, m, d) = "mdy", (c, a, b)
    try:
        day = dt.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new, kept = None, _date_class(m, d)
    while new is None or _date_class(new.month, new.day) != kept:
        day = FIRST_DAY + feistel(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date", undo)
        new = dt.date.fromordinal(day)
    written = {"y": new.year, "m": new.month, "d": new.day}
    return mark.join(f"{written[k]:0{len(part)}d}" for k, part in zip(order, parts, strict=True))


def _date_class(month: int, day: int) -> tuple[bool, int]:
    """Dates are permuted within those that have as many digits and that can or can't be read month first alike, so that a pseudonym is read as its value was."""
    return month > 9, (day > 9) + (day > 12)


def _word(kind: str) -> Callable[[str, bytes, bool], str | None]:
    def permute(found: str, key: bytes, undo: bool) -> str | None:
        alphabet = "0123456789abcdef" if kind == "secret" and re.fullmatch(r"[0-9a-f]{16,}", found) else None
        symbols = [(c, alphabet or _alphabet(c)) for c in found]
        return _mixed(symbols, key, kind, undo) if any(len(a) > 1 for _, a in symbols) else None

    return permute


KINDS: dict[str, Callable[[str, bytes, bool], str | None]] = {
    "card": _card, "ssn": _ssn, "ip": _ip, "phone": _phone, "iban": _iban, "date": _date, "email": _word("email"), "secret": _word("secret"),
}


def pseudonym(kind: str, value: str, key: bytes) -> str | None:
    """The pseudonym of a value, or None where it isn't valid for its kind."""
    return _remembered(kind, value, key) if len(value) <= REMEMBERED else KINDS[kind](value, key, False)


@lru_cache(30_000)
def _remembered(kind: str, value: str, key: bytes) -> str | None:
    return KINDS[kind](value, key, False)


def reveal(kind: str, value: str, key: bytes) -> str | None:
    """The value of a pseudonym, by the key."""
    return KINDS[kind](value, key, True)


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
        "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 "
        "SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a value may end: an IBAN at its country's length, or else before any word that its pattern took in too, the longest first."""
    if kind != "iban":
        return [end]
    ends = [end, *(i for i in range(end - 1, start, -1) if text[i] == " ")]
    size = IBAN_LENGTHS.get(text[start : start + 2])
    return sorted(ends, key=lambda e: len(text[start:e].replace(" ", "")) != size)


def _numbers(text: str, valid: Callable[[str, str], object]) -> Iterator[tuple[int, int, str]]:
    """Valid values that have digits; after one that isn't valid, the search goes on inside it."""
    at = 0
    while (met := NUMBERS.search(text, at)) is not None:
        at = met.start() + 1
        tries = ((m.start(), e, k) for k, p in PATTERNS if (m := p.match(text, met.start())) for e in _ends(k, text, m.start(), m.end()))
        if (own := next((s for s in tries if valid(s[2], text[s[0] : s[1]]) is not None), None)) is not None:
            yield own
            at = own[1]


def find(text: str, key: bytes = b"") -> list[tuple[int, int, str]]:
    """Start, end and kind of the values, by place; at one place the longer of two comes first."""
    spans = []
    if any(c in text for c in DIGITS):
        spans += _numbers(text, lambda kind, value: pseudonym(kind, value, key))
    if "@" in text:
        spans += [(m.start(1), m.end(1), "email") for m in EMAIL.finditer(text)]
    if ":" in text or "=" in text:
        spans += [(m.start(1), m.end(1), "secret") for m in SECRET.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], -s[1]))


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and kind, start, end (in the original) of each."""
    out, at, found = [], 0, []
    for start, end, kind in find(text, key):
        if start < at or (new := pseudonym(kind, text[start:end], key)) is None:
            continue
        out += [text[at:start], new]
        found.append((kind, start, end))
        at = end
    return ("".join([*out, text[at:]]) if found else text), found


def pseudonymize(docs: DataFrame, key: bytes, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` as they are, the text with pseudonyms, and the places found."""
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")
    keep = [docs.schema[c] for c in columns if c != "text"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, []) if t is None else replace(t, key) for t in batch.column("text").to_pylist()]
            places = [[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in done]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array([t for t, _ in done], pa.string()), pa.array(places, kind)], [*(f.name for f in keep), "text", "found"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string", f"found {FOUND}"])
    return docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col("text").cast("string")).mapInArrow(run, schema)
