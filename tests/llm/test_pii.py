import datetime as dt
import random

import pytest

from tests.conftest import SF
from tests.llm.helpers import docs
from tidemark.llm import pii

KEY = b"0123456789abcdef"


@pytest.mark.parametrize("size", [2, 3, 10, 26, 1000, 73049])
def test_feistel_is_a_permutation(size):
    n = min(size, 1000)
    got = [pii.feistel(i, size, KEY, "t") for i in range(n)]
    assert all(0 <= x < size for x in got) and len(set(got)) == n
    assert [pii.feistel(x, size, KEY, "t", undo=True) for x in got] == list(range(n))
    if size > 100:
        assert got != [pii.feistel(i, size, b"another key 1234", "t") for i in range(n)]


VALUES = [
    ("card", "4111 1111 1111 1111"), ("card", "378282246310005"), ("ssn", "123-45-6789"), ("ip", "152.143.123.131"), ("phone", "+1 (743) 555-3824"),
    ("phone", "+1 (017) 555-7713"), ("phone", "212-555-0187"), ("phone", "+44 20 7946 0958"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("date", "2021-02-28"), ("date", "12/31/1999"),
    ("date", "31.12.1999"), ("email", "that.92"), ("secret", "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"),
]


@pytest.mark.parametrize(("kind", "value"), VALUES)
def test_format_kept_and_reversible(kind, value):
    new = pii.pseudonym(kind, value, KEY)
    assert new != value
    if kind not in ("ip", "date", "secret"):
        assert [c if not c.isalnum() else c.isdigit() for c in new] == [c if not c.isalnum() else c.isdigit() for c in value]
    assert pii.reveal(kind, new, KEY) == value
    around = {"email": f"x {new}@a.org", "secret": f'token = "{new}"'}.get(kind, f"x {new} y")
    assert [k for _, _, k in pii.find(around)] == [kind]  # still valid for its kind


def test_linked_across_notations():
    a, b = pii.pseudonym("card", "4111111111111111", KEY), pii.pseudonym("card", "4111-1111-1111-1111", KEY)
    assert a == b.replace("-", "")
    a, b = pii.pseudonym("date", "2021-02-28", KEY), pii.pseudonym("date", "28.02.2021", KEY)
    assert dt.date.fromisoformat(a) == dt.datetime.strptime(b, "%d.%m.%Y").date()


def test_invalid_values_stay(spark):
    texts = ["4111111111111112 and 300.1.2.3 and 2021-02-30 and 000-12-3456 v1.2.3.4.5", None, "", "no data at all"]
    rows = pii.pseudonymize(docs(spark, texts), KEY).orderBy("doc_id").collect()
    assert [r.text for r in rows] == texts and all(r.found == [] for r in rows)


def test_documents(spark):
    text = 'Mail jo.doe7@mail.example.com or +1 (743) 555-3824### from 8.8.4.4, token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"$$$'
    a, b, long = pii.pseudonymize(docs(spark, [text, text, "filler " * 50_000 + text]), KEY).orderBy("doc_id").collect()
    assert a.text == b.text and long.text == "filler " * 50_000 + a.text
    assert [f.kind for f in a.found] == ["email", "phone", "ip", "secret"]
    for f in a.found:
        assert text[f.start : f.end] not in a.text
    assert pii.pseudonymize(docs(spark, []), KEY).count() == 0


FORMS = [
    ("iban", "ES9121000418450200051332", " EUR 100"), ("iban", "BE68 5390 0754 7034", " IS"), ("iban", "AT611904300234573201", " THE END"), ("iban", "CZ65 0800 0000 1920 0014 5399", " EUR"),
    ("iban", "SE45 5000 0000 0583 9825 7466", " SEK 20"), ("iban", "PL61109010140000071219812874", " PLN 5"), ("iban", "NO93 8601 1117 947", " NOK"),
    ("date", "2024-01-15", "T10:00:00Z"), ("phone", "555 123 4567", " now"), ("phone", "1-555-123-4567", "."), ("phone", "1 555 123 4567", ","), ("phone", "+33 1 23 45 67 89", "."),
    ("phone", "+49 30 12 34 56 78", ","), ("phone", "+45 12 34 56 78", ""), ("phone", "+7 12 345 678 90", ""),
]


@pytest.mark.parametrize(("kind", "value", "after"), FORMS)
def test_forms_among_other_words(kind, value, after):
    done, found = pii.replace(f"by {value}{after}", KEY)
    assert found == [(kind, 3, 3 + len(value))]
    new = done[3 : 3 + len(value)]
    assert value not in done and done == f"by {new}{after}" and pii.reveal(kind, new, KEY) == value
    assert pii.find(done) == [(3, 3 + len(value), kind)]


def test_search_goes_on_inside_what_is_not_valid():
    # Neither the IBAN's form nor the number of 13 to 19 digits is valid; the values inside are.
    for text, value in [("XX00 1234 5678 4111 1111 1111 1111", "4111 1111 1111 1111"), ("AA11 BE68 5390 0754 7034", "BE68 5390 0754 7034")]:
        done, found = pii.replace(text, KEY)
        assert [text[a:b] for _, a, b in found] == [value] and value not in done


@pytest.mark.parametrize("form", ["{y:04d}-{m:02d}-{d:02d}", "{y:04d}/{m}/{d}", "{d:02d}.{m:02d}.{y:04d}", "{d}.{m}.{y:04d}", "{m:02d}/{d:02d}/{y:04d}", "{d:02d}/{m:02d}/{y:04d}", "{m}-{d}-{y:04d}", "{d}-{m:02d}-{y:04d}", "{m:02d}-{d}-{y:04d}"])
def test_dates_of_all_notations_come_back(form):
    r = random.Random(form)
    for _ in range(1200):
        day = dt.date.fromordinal(r.randrange(pii.FIRST_DAY, pii.LAST_DAY + 1))
        value = form.format(y=day.year, m=day.month, d=day.day)
        new = pii.pseudonym("date", value, KEY)
        assert len(new) == len(value) and pii.reveal("date", new, KEY) == value


def naive(text):
    """The values of a text, by trying every kind at every place, the longest first where IBANs end."""
    out, at = [], 0
    while at < len(text):
        for kind, pattern in pii.PATTERNS:
            m = pattern.match(text, at)
            ends = [] if m is None else [m.end()] if kind != "iban" else [e for e in range(m.end(), at, -1) if e == m.end() or text[e] == " "]
            ends.sort(key=lambda e: len(text[at:e].replace(" ", "")) != pii.IBAN_LENGTHS.get(text[at : at + 2]))
            end = next((e for e in ends if pii.KINDS[kind](text[at:e], KEY, False) is not None), None)
            if end is not None:
                out.append((at, end, kind))
                at = end - 1
                break
        at += 1
    out += [(m.start(1), m.end(1), "email") for m in pii.EMAIL.finditer(text)] + [(m.start(1), m.end(1), "secret") for m in pii.SECRET.finditer(text)]
    kept, free = [], 0
    for a, b, kind in sorted(out, key=lambda x: (x[0], -x[1])):
        if a >= free and pii.KINDS[kind](text[a:b], KEY, False) is not None:
            kept.append((kind, a, b))
            free = b
    return kept


def test_whole_table(spark):
    """Finds equal those of a search at every place; pseudonyms lead back to each whole text, and one value has one pseudonym."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    df = df.unionByName(df.limit(3))  # repeated rows
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    rows = pii.pseudonymize(df, KEY).collect()
    linked = {}
    assert len(rows) == len(texts) + 3
    for r in rows:
        text, back, at = texts[r.doc_id], [], 0
        found = [(f.kind, f.start, f.end) for f in r.found]
        if text is None:
            assert r.text is None and not found
            continue
        assert found == naive(text)
        shift = 0
        for kind, a, b in found:
            new = pii.pseudonym(kind, text[a:b], KEY)
            assert linked.setdefault((kind, text[a:b]), new) == new
            assert r.text[a + shift : a + shift + len(new)] == new
            back += [r.text[at : a + shift], pii.reveal(kind, new, KEY)]
            shift += len(new) - (b - a)
            at = b + shift
        assert "".join([*back, r.text[at:]]) == text


@pytest.mark.parametrize("n", [10, 63, 64, 65, 128, 200, 3040, 20_000, 1_000_000])
def test_words_of_any_length(n):
    r = random.Random(n)
    word = "".join(r.choices("abcXYZ019_-", k=n))
    for kind, text in (("secret", f"token={word}"), ("email", f"mail {word.replace('_', '.')}@x.org")):
        done, found = pii.replace(text, KEY)
        assert found and len(done) == len(text)
        value = text[found[0][1] : found[0][2]]
        new = done[found[0][1] : found[0][2]]
        assert pii.reveal(kind, new, KEY) == value and all(pii._alphabet(a) == pii._alphabet(b) for a, b in zip(value, new, strict=True))
        if n >= 200:  # one changed symbol changes every chunk
            i = next(i for i in range(n // 2, n) if value[i].isdigit())
            other = pii.pseudonym(kind, value[:i] + str((int(value[i]) + 1) % 10) + value[i + 1 :], KEY)
            assert all(other[j : j + 64] != new[j : j + 64] for j in range(0, n - n % 64, 64))
