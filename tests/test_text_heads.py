"""Text heads against dense gradient descent in NumPy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.operators import text_heads
from tidemark.plans import load

SIZE = 64


def table(n=60):
    r = random.Random(3)
    rows = []
    for i in range(n):
        words = [r.choice("good bad fine poor news flat".split()) for _ in range(r.randrange(0, 9))]
        t = None if i == 5 else " ".join(words)
        rows.append((i, t, (words.count("good") - words.count("bad")) / 10 + r.gauss(0, 0.02), None if i == 7 else r.gauss(0, 1)))
    return rows


def test_against_numpy(spark):
    rows = table()
    df = spark.createDataFrame(rows, "k int, t string, y1 double, y2 double").repartition(3)
    heads = {"char": ("char", (2,)), "word": ("word", (1,))}
    x = text_heads.features(df, "k", "t", heads, SIZE)
    got = {r.k: r for r in x.collect()}
    assert set(got) == {r[0] for r in rows} and got[5].word_at == []
    one = lambda kind, g: int(text_heads.GRAMS[kind](g, (len(g) if kind == "char" else 1,))[0]) % SIZE

    def dense(head):
        out = np.zeros((len(rows), SIZE))
        for k, t, *_ in rows:
            found = [] if not t else t.split() if head == "word" else [t[i : i + 2] for i in range(len(t) - 1)]
            for b, n in Counter(one(head, g) for g in found).items():
                out[k, b] = n
        return out / np.maximum(np.sqrt((out**2).sum(1, keepdims=True)), 1e-300)

    cut = 40
    model = text_heads.fit(x.join(df.select("k", "y1", "y2"), "k").where(F.col("k") < cut), ["char", "word"], ["y1", "y2"], SIZE, rounds=15)
    y = np.array([[np.nan if v is None else min(0.2, max(-0.2, v)) for v in r[2:]] for r in rows])
    use = [i for i in range(cut) if not np.isnan(y[i]).any()]
    z = (y[use] - y[use].mean(0)) / y[use].std(0, ddof=1)
    scores = {r.k: r for r in x.select("k", model.column("char", [0.7, 0.3]).alias("char"), model.column("word", [0.7, 0.3]).alias("word")).collect()}
    for h, head in enumerate(("char", "word")):
        m = dense(head)
        w = np.zeros((2, SIZE + 1))
        for _ in range(15):
            for t in range(2):
                pull = np.clip(m[use] @ w[t, :-1] + w[t, -1] - z[:, t], -0.1, 0.1)
                w[t] -= 0.5 * (np.append(pull @ m[use], pull.sum()) / len(use) + 1e-4 * np.append(w[t, :-1], 0))
        assert np.allclose(model.weights[h], w, atol=1e-7)
        want = (np.column_stack([m @ w[t, :-1] + w[t, -1] for t in range(2)])) @ [0.7, 0.3]
        assert np.allclose([scores[k][head] for k in range(len(rows))], want, atol=1e-7)
    later = [k for k in range(cut, len(rows))]
    assert np.corrcoef([scores[k].word for k in later], y[later, 0])[0, 1] > 0.4


def test_nothing_to_fit(spark):
    df = spark.createDataFrame([(1, "a b", None)], "k int, t string, y double")
    x = text_heads.features(df, "k", "t", {"word": ("word", (1, 2))}, SIZE).join(df, "k")
    with pytest.raises(ValueError, match="no rows"):
        text_heads.fit(x, ["word"], ["y"], SIZE)


def test_grams():
    """Equal runs have equal hashes, others of the sizes asked for don't, whatever stands around them."""
    a, b = "naïve 😀 text", "xx naïve 😀 tex"
    for n in (2, 3):
        own = {a[i : i + n]: h for i, h in enumerate(text_heads.char_grams(a, (n,)).tolist())}
        for i, h in enumerate(text_heads.char_grams(b, (n,)).tolist()):
            assert (own.get(b[i : i + n]) == h) == (b[i : i + n] in own) and (h in own.values()) == (b[i : i + n] in own)
    assert len(text_heads.char_grams("a", (2, 3))) == 0 and len(text_heads.word_grams("one two one two", (1, 2))) == 4 + 3
    assert len(set(text_heads.word_grams("one two one two", (1, 2)).tolist())) == 4


def test_workers_hold_few_rows(spark, monkeypatch):
    seen, features = [], text_heads.features
    monkeypatch.setattr(text_heads, "features", lambda df, *a: seen.append(df.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or features(df, *a))
    got = load()[0]["text_hash_model"](spark, SF)
    assert seen == [str(text_heads.BATCH)] and got.count() > 0 and got.sparkSession is spark
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
