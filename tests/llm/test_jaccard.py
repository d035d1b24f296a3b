import math
import random

import numpy as np
import pytest

from tests.conftest import SF
from tests.llm.helpers import docs
from tidemark.llm import jaccard
from tidemark.llm.components import components


def brute(rows):
    """doc_id -> (class, links, set links) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids = sorted(sets)
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b:
                x, y = sets[a], sets[b]
                if x == y or (x and y and len(x & y) * 9 >= 4 * (len(x) + len(y))):
                    near[a].add(b)
                    near[b].add(a)
    out, seen = {}, {}
    for i in ids:
        if i not in seen:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen[k] = i
                    todo += near[k]
        out[i] = (seen[i], len(near[i]), len({sets[j] for j in near[i]} - {sets[i]}))
    return out


def got(df):
    return {r.doc_id: (r.class_id, r.n_links, r.n_set_links) for r in df.collect()}


def test_awkward(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    near = base[:60] + ["zzz"] + base[61:]
    far = base[:60] + [f"v{i}" for i in range(60)]
    texts = ["", None, "  \n", "one", "One", "one two three four", " ".join(base), " ".join(base).upper(), "\n".join(near), " ".join(far), " ".join(base * 300), "a b c d e f", "a b c d e g"]
    assert got(jaccard.near_duplicates(docs(spark, texts))) == brute(enumerate(texts))
    assert got(jaccard.near_duplicates(docs(spark, []))) == {}


def test_large_group_of_near_copies_and_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 60)
    monkeypatch.setattr(jaccard, "LIMIT", 40)
    monkeypatch.setattr(jaccard, "CROWD", 10)
    r = random.Random(4)
    base = [f"w{r.randrange(900)}" for _ in range(100)]
    texts = []
    for _ in range(150):  # near copies at different distances
        own = base.copy()
        for _ in range(r.randrange(4)):
            own[r.randrange(100)] = f"n{r.randrange(10**6)}"
        texts.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(60)) for _ in range(100)]
    assert got(jaccard.near_duplicates(docs(spark, texts))) == brute(enumerate(texts))


def test_pieces_of_a_long_text(monkeypatch):
    r = random.Random(8)
    for n in (1, 3, 4, 5, 6, 40, 300):
        text = " ".join("w" * r.randrange(1, 9) + str(r.randrange(60)) for _ in range(n))
        monkeypatch.setattr(jaccard, "PIECE_BYTES", 1 << 20)
        whole = jaccard.shingles(text).tolist()
        monkeypatch.setattr(jaccard, "PIECE_BYTES", 25)
        assert jaccard.shingles(text).tolist() == whole


def test_recall(spark, monkeypatch):
    """Pairs near the threshold, found by a plain inverted index of shingles, that the recursion links; every large node is split down."""
    monkeypatch.setattr(jaccard, "LIMIT", 30)
    r = random.Random(5)
    common = [f"p{i}" for i in range(40)]  # a passage of every text
    texts = []
    for k in range(150):
        base = common + [f"w{k}x{i}" for i in range(160)]
        copy = base.copy()
        copy[190 - r.randrange(4, 21) :] = [f"v{k}x{i}" for i in range(r.randrange(5, 20))]
        texts += [" ".join(base), " ".join(copy)]
    want = brute_pairs(list(enumerate(texts)))
    rows = {x.doc_id: x.class_id for x in jaccard.near_duplicates(docs(spark, texts)).collect()}
    met = sum(rows[a] == rows[b] for a, b in want)
    assert len(want) > 50 and met >= 0.99 * len(want)


def brute_pairs(rows):
    """Pairs at or above the threshold, candidates from an inverted index of all shingles."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for i, t in rows if (w := (t or "").lower().split())}
    return [(a, b) for a in sets for b in sets if a < b and abs(len(sets[a]) - len(sets[b])) < 60 and len(sets[a] & sets[b]) * 9 >= 4 * (len(sets[a]) + len(sets[b]))]


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(jaccard.near_duplicates(df)) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    root = {}
    for a, b in edges:
        for x in (a, b):
            root.setdefault(x, x)
        ra, rb = root[a], root[b]
        for x in root:
            if root[x] in (ra, rb):
                root[x] = min(ra, rb)
    want = {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_spread():
    near = np.zeros((5, 5), bool)
    for a, b in ((0, 3), (3, 4), (1, 2)):
        near[a, b] = near[b, a] = True
    assert jaccard._spread(near).tolist() == [0, 1, 1, 0, 0]


def signatures_alike(n, likeness, seed):
    """Tokens of sets that share a passage and have shingles of their own, any two of them so much alike."""
    r = np.random.default_rng(seed)
    own = (1 - likeness) / (2 * likeness)
    shared, mine = r.exponential(1, jaccard.TOKENS), r.exponential(1 / own, (n, jaccard.TOKENS))
    values = r.integers(0, 2**32, (n, jaccard.TOKENS), dtype=np.uint32)
    return np.where(shared < mine, np.arange(jaccard.TOKENS, dtype=np.uint32), values)


@pytest.mark.parametrize(("likeness", "most"), [(0.5, 50), (0.6, 80), (0.7, 120)])
@pytest.mark.parametrize("seed", [3, 4])
def test_similar_texts_do_not_multiply(likeness, most, seed):
    """Rows made per set by all runs, additional ones included, for 20,000 sets below the threshold: the loop of coarse_components without its pivots."""
    n = 20_000
    values = signatures_alike(n, likeness, seed)
    made, runs, turn = 0, jaccard.RUNS, 0
    root = lambda r, ids: (lambda row, node, used: (ids[row], node, used))(*jaccard.children(np.full(len(ids), jaccard.mix(np.array([r + 1], np.uint64))[0]), np.zeros(len(ids), np.uint64), values[ids]))
    nodes = [root(r, np.arange(n)) for r in range(runs)]
    while nodes:
        ids, node, used = (np.concatenate(x) for x in zip(*nodes, strict=True))
        made += len(ids)
        _, back, count = np.unique(node, return_inverse=True, return_counts=True)
        large = count[back] > jaccard.LIMIT
        ids, node, used = ids[large], node[large], used[large]
        if not len(ids):
            break
        row, node, used = jaccard.children(node, used, values[ids])
        again, node, used = jaccard.children(node, used, values[ids[row]])
        nodes = [(ids[row][again], node, used)]
        turn += 1
        assert turn <= math.ceil(math.log(n) / math.log(1.25)) / 2
        if turn > 1 and turn & (turn - 1) == 0:
            nodes += [root(r, np.unique(ids)) for r in range(runs, runs + jaccard.EXTRA)]
            runs += jaccard.EXTRA
    assert made <= most * n, made / n


def test_used_places_are_not_taken_again():
    r = np.random.default_rng(1)
    values = r.integers(0, 2**32, (500, jaccard.TOKENS), dtype=np.uint32)
    at, node, used = np.arange(500), np.full(500, 7, np.uint64), np.zeros(500, np.uint64)
    for level in range(1, 30):
        row, node, used = jaccard.children(node, used, values[at])
        at = at[row]
        assert all(int(u).bit_count() == level for u in used)
        keep = r.permutation(len(at))[:500]
        at, node, used = at[keep], node[keep], used[keep]


def test_form_letters_end(spark):
    """Thousands of texts that are alike, but no near duplicates, and a few that are."""
    r = random.Random(2)
    form = " ".join(f"form{i}" for i in range(140))
    texts = [form + " " + " ".join(f"own{r.randrange(10**9)}" for _ in range(30)) for _ in range(6000)]
    texts += [t + " tail" for t in texts[:20]]
    rows = jaccard.near_duplicates(docs(spark, texts)).collect()
    assert {(x.doc_id, x.class_id) for x in rows if x.n_links} == {(i, i % 6000) for k in range(20) for i in (k, 6000 + k)}
