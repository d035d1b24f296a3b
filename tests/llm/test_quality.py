import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import quality
from tidemark.llm.quality import ORDER


def units(text):
    raw = text.encode("utf-16-le")
    return [raw[i : i + 2] for i in range(0, len(raw), 2)]


def brute_model(texts):
    """Interpolated modified Kneser-Ney by its definition: gram (tuple of characters) -> probability."""
    padded = [["<"] * (ORDER - 1) + units(t) + [">"] for t in texts]
    counts = {ORDER: Counter(tuple(p[i : i + ORDER]) for p in padded for i in range(len(p) - ORDER + 1))}
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    rates = {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        rates[k] = [0.0] + [max(0.1 * i, min(0.95 * i, i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.5 * i)) for i in (1, 2, 3)]
    contexts = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            contexts[k][g[:-1]].append(v)

    def p(gram):
        k = len(gram)
        below = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        own = contexts[k].get(gram[:-1])
        if not own:
            return below
        freed = sum(rates[k][min(v, 3)] for v in own)
        a = counts[k].get(gram, 0)
        return (a - rates[k][min(a, 3)] + freed * below) / sum(own)

    return p


def perplexity(p, text):
    s = ["<"] * (ORDER - 1) + units(text) + [">"]
    g = [tuple(s[i : i + ORDER]) for i in range(len(s) - ORDER + 1)]
    return math.exp(-sum(math.log(p(x)) for x in g) / len(g)), len(g)


def prose(r, n):
    return " ".join(r.choice(["the", "of", "water", "stone", "river", "and", "runs", "over", "old"]) for _ in range(n)) + "."


@pytest.mark.parametrize("model_rows", [2_000_000, 300])
def test_against_brute_force(spark, monkeypatch, model_rows):
    monkeypatch.setattr(quality, "MODEL_ROWS", model_rows)
    monkeypatch.setattr(quality, "PIECE", 2000)
    r = random.Random(9)
    texts = [prose(r, r.randrange(3, 60)) for _ in range(120)] + ["#$%^ qxzj" * 20, "", None, "😀 river", "stone", "x" * 5000, "\x02\x02\x03 stone 😁", "stone", "@@@@ !!!!", "@@@@ !!!!"]
    df = docs(spark, texts, lang=["en"] * 128 + [None, "xx"]).withColumn("edges", F.lit(1))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(3, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(df, labels, ["doc_id", "text", "lang"]).collect()
    fold = {x.doc_id: x.f for x in df.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {quality.FOLDS}) as f").collect()}
    trusted = [i for i in range(100) if i not in (3, 4)]
    p = brute_model([texts[i] for i in trusted if fold[i]])
    assert len(rows) == len(texts)
    for x in rows:
        if not x.text:
            assert x.perplexity is None and not x.keep
        elif x.lang != "en":
            assert x.perplexity is None and x.keep
        else:
            want, n = perplexity(p, x.text)
            assert x.n_grams == n and x.perplexity == pytest.approx(want, rel=1e-9)
    held = sorted(perplexity(p, texts[i])[0] for i in trusted if not fold[i])
    threshold = held[math.ceil(quality.QUANTILE * len(held)) - 1]
    by_id = {x.doc_id: x for x in rows}
    assert by_id[0].threshold == pytest.approx(threshold)
    assert not by_id[120].keep
    assert all(by_id[i].keep == (by_id[i].perplexity <= threshold) for i in range(120))
    assert sum(by_id[i].keep for i in range(120)) > 110
    assert all("edges" not in x for x in rows)


def test_probabilities_sum_to_one(spark):
    p = brute_model(["abab abc", "abcab"])
    a, b, *rest = units("abc ")
    assert sum(p((a, b, a, s)) for s in (a, b, *rest, ">", "unseen")) == pytest.approx(1)


def test_length_classes(spark, monkeypatch):
    """Each language's classes hold equal shares of its held-out documents, and each has its own quantile."""
    monkeypatch.setattr(quality, "CLASS_ROWS", 20)
    r = random.Random(4)
    rows = [(lang, r.randrange(1, 500), r.random() * 9) for lang, n in (("a", 100), ("b", 15), (None, 30)) for _ in range(n)] + [("c", 7, float(i)) for i in range(50)]
    got = {x.limit_lang: x for x in quality.length_limits(spark.createDataFrame(rows, "lang string, n_grams long, perplexity double"), 0.9).collect()}
    for lang, classes in (("a", 8), ("b", 1), ("", 2), ("c", 4)):
        own = [(n, p) for x, n, p in rows if (x or "") == lang]
        edges = got[lang].edges
        assert len(edges) == classes - 1
        lengths = sorted(n for n, _ in own)
        assert edges == [lengths[math.ceil(len(lengths) * i / classes) - 1] for i in range(1, classes)]
        for k in {sum(n > e for e in edges) for n, _ in own}:
            here = sorted(p for n, p in own if sum(n > e for e in edges) == k)
            assert got[lang].thresholds[k] == here[math.ceil(0.9 * len(here)) - 1]


def test_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs(spark, ["a text", ""]), labels, ["doc_id", "text", "lang"]).orderBy("doc_id").collect()
    assert [x.keep for x in rows] == [True, False]
    assert quality.classify(docs(spark, []), labels, ["doc_id", "text", "lang"]).count() == 0
