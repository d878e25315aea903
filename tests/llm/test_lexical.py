"""Ranked lexical search: the treap against a dense grid, the search against a plain count of its contract."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sheetwright.llm import lexical_topk as lx

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def by_hand(docs, items, k):
    found = [(i, TERM.findall((t or "").translate(FOLD))) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in {*t})
    out = []
    for item, text in {(i, t or "") for i, t in items}:
        wanted = {*TERM.findall(text.translate(FOLD))}
        scored = []
        for i, t in found:
            tf, score = Counter(t), 0
            for w in wanted & {*tf}:
                m = 50 + 50 * len(t) * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if null else i, -score) for rank, (score, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", [(1, 1), (2, 1), (3, 9), (40, 70), (64, 64)])
def test_treap_holds_the_grid(shape):
    rng = np.random.default_rng(sum(shape))
    grid = rng.integers(1, 1000, shape) * (rng.random(shape) < 0.3)
    grid[0, 0] = 7
    rows, cols = np.nonzero(grid)
    treap = lx.Treap(rows, cols, grid[rows, cols], *shape)
    assert treap.root == grid.max() and int(np.bitwise_count(treap.bits).sum()) == len(treap.short) - 1
    r, c = (x.ravel() for x in np.indices(shape))
    cell, most = np.zeros(len(r), np.int64), np.full(len(r), treap.root)
    for level in range(treap.height):
        bit = treap.height - 1 - level
        cell, most = treap.child(cell, (r >> bit & 1) * 2 + (c >> bit & 1), most)
        for k in range(0, len(r), 7):  # a cell's maximum is that of its square
            lo_r, lo_c = r[k] >> bit << bit, c[k] >> bit << bit
            assert most[k] == grid[lo_r : lo_r + (1 << bit), lo_c : lo_c + (1 << bit)].max(initial=0)
    assert (most.reshape(shape) == grid).all()


def test_descent_finds_the_best_and_prunes(monkeypatch):
    monkeypatch.setattr(lx, "STATES", 16)
    rng = np.random.default_rng(8)
    grid = (rng.pareto(1.5, (128, 2048)) * 50).astype(np.int64) * (rng.random((128, 2048)) < 0.2)
    rows, cols = np.nonzero(grid)
    treap = lx.Treap(rows, cols, grid[rows, cols], *grid.shape)
    ids, null = np.sort(rng.choice(5_000, 2048, replace=True)), np.arange(2048) > 2_040
    halved = []
    for n in (1, 3, 10, 40):
        for _ in range(5):
            wanted, weights = rng.choice(128, n, replace=False), rng.integers(1, 5_000, n)
            best = lx.Best(10)
            halved.append(lx.descend(treap, wanted, weights, ids, null, best))
            score = weights @ grid[wanted]
            want = sorted((-s, bool(u), int(i)) for s, u, i in zip(score, null, ids) if s > 0)[:10]
            assert [(-s, u, i) for s, u, i in zip(best.scores.tolist(), best.null.tolist(), best.ids.tolist())] == want
    assert max(halved) < 1_000 and np.mean(halved[:5]) < 500  # of 2,047 states


WORDS = ["the", "The", "of", "é", "ÉA", "x1", "and", "zeta", "rare", "lorem", "ipsum", "a-b", "漢字", "don't", "\x7f", "\x85"]


def text_of(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(rng.randint(0, n)))


def test_search(spark):
    rng = random.Random(12)
    docs = [(k, text_of(rng, 30)) for k in range(400)] + [(k, "the same rare text") for k in range(1_000, 1_100)] + [(None, "rare zeta"), (None, None), (5, "rare rare"), (5, "rare rare"), (2_000, ""), (2_001, "of zeta " * 20_000)]
    items = [(k, text_of(rng, 12)) for k in range(30)] + [(1, "the same rare text"), (40, None), (41, " - "), (42, "unheard"), (43, "rare"), (43, "rare"), (None, "zeta of")]
    d = spark.createDataFrame([(i, t, 1, "r") for i, t in docs], "doc_id long, text string, item_id int, term string").repartition(3)
    q = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    for k, more in ((50, {}), (3, {"slice_terms": 3, "part_queries": 7})):
        got = lx.search(d, q, k=k, **more).collect()
        assert sorted((tuple(r) for r in got), key=repr) == by_hand(docs, items, k)
    assert lx.search(d.limit(0), q).collect() == lx.search(d, q.limit(0)).collect() == lx.search(d.filter("text = ''"), q).collect() == []


def test_small_chunks(spark, monkeypatch):
    """Many chunks of one partition: what a query has found prunes the next, and the result stays the same."""
    rng = random.Random(13)
    docs, items = [(k, text_of(rng, 30)) for k in range(300)], [(k, text_of(rng, 10)) for k in range(12)]
    best = {i: lx.Best(5) for i, _ in items}
    found = [(i, lx.terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = Counter(w for _, t in found for w in {*t})
    names = sorted(df)
    for k in range(0, 300, 32):
        part = found[k : k + 32]
        points = [(names.index(w), c, lx.impacts(np.array([tf]), np.array([len(t)]), n_docs, n_terms)[0]) for c, (_, t) in enumerate(part) for w, tf in Counter(t).items()]
        treap = lx.Treap(*np.array(points).T, len(names), len(part))
        for i, text in items:
            wanted = sorted({*lx.terms(text)} & {*names})
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) for w in wanted], np.int64)
            lx.descend(treap, np.array([names.index(w) for w in wanted], int), weights, np.array([i for i, _ in part]), np.zeros(len(part), bool), best[i])
    got = [(i, r + 1, int(d), int(s)) for i, b in best.items() for r, (d, s) in enumerate(zip(b.ids, b.scores))]
    assert sorted(got, key=repr) == by_hand(docs, items, 5)
