"""Alignment of tokenizers: products of incidence matrices against dense ones, and documents against a plain count."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
from sheetwright.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [*"ab'sT  \n\t\r .,<>/_-0123éüñ漢字　\xa0​\x1c\x1f\x85😀", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "<unk>", " the", "'ll", "  ", "    ", "▁", "Ａ", "ﬁ", "\x00"]


@pytest.fixture(scope="module")
def pair():
    return ta.Pair(A, B)


def by_hand(pair, rows):
    """The contract, document by document and token by token."""
    found, held = [], Counter()
    for i, text in rows:
        a = pair.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        if not text or b"".join(pair.a_bytes[x] for x in a) != (" " + text).encode() or b"".join(pair.b_bytes[x] for x in b) != (" " + text).encode():
            found.append((i, [], [], [], []))
            continue
        a_to, b_to = np.cumsum([len(pair.a_bytes[x]) for x in a]).tolist(), np.cumsum([len(pair.b_bytes[x]) for x in b]).tolist()
        links, j = [], 0
        for k, end in enumerate(a_to):
            start = a_to[k - 1] if k else 0
            while j and (b_to[j - 1] if j else 0) > start:
                j -= 1
            while j < len(b) and (b_to[j - 1] if j else 0) < end:
                if b_to[j] > start:
                    links.append((a[k], b[j]))
                j += 1
        both = sorted({*a_to} & {*b_to})
        groups = [([], []) for _ in both]
        for side, (ids, ends) in enumerate(((a, a_to), (b, b_to))):
            for x, e in zip(ids, ends):
                groups[bisect.bisect_left(both, e)][side].append(x)
        held.update({*links})
        found.append((i, a, b, groups, links))
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for i, a, b, groups, links in found:
        line = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        digest = hashlib.sha256(line.encode()).hexdigest() if line else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(len(x) * len(y) for x, y in groups), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "n_best", "count_sum", "groups_sha256"]


def test_gustavson_equals_the_dense_product():
    rng = np.random.default_rng(3)

    def csr(m):
        cols = [np.flatnonzero(r) for r in m]
        return ta.Csr(np.cumsum([0, *map(len, cols)]), np.concatenate([*cols, np.empty(0, int)]).astype(int), m[m != 0], m.shape[1])

    def dense(c):
        m = np.zeros((len(c.indptr) - 1, c.n_cols), np.int64)
        m[c.rows, c.cols] = c.data
        return m

    for n, k, m in ((4, 5, 6), (1, 1, 1), (7, 3, 2), (0, 3, 2), (3, 2, 0)):
        for _ in range(20):
            a, b = rng.integers(0, 4, (n, k)) * rng.integers(0, 2, (n, k)), rng.integers(0, 4, (k, m)) * rng.integers(0, 2, (k, m))
            assert (dense(ta.gustavson(csr(a), csr(b))) == a @ b).all()
            assert ta.product_sizes(csr(a), csr(b)).tolist() == [int((b[np.flatnonzero(r)] != 0).sum()) for r in a]


def test_links_and_groups_of_one_text():
    al = ta.align_ends(np.array([3, 4, 9]), np.array([1, 4, 6, 9]))
    assert al.group_ends.tolist() == [4, 9]
    assert list(zip(al.overlap.rows.tolist(), al.overlap.cols.tolist(), al.overlap.data.tolist())) == [(0, 0, 1), (0, 1, 2), (1, 1, 1), (2, 2, 2), (2, 3, 3)]
    shared = al.shared()
    assert list(zip(shared.rows.tolist(), shared.cols.tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3)]
    none = ta.align_ends(np.array([], int), np.array([], int))
    assert len(none.overlap.data) == len(none.group_ends) == len(none.shared().data) == 0


def test_parts_encode_as_whole_texts(pair):
    assert pair.in_parts
    rng = random.Random(5)
    for _ in range(3_000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(1, 60)))
        a, b = pair.encode(pair.parts(text))
        whole_a, whole_b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        assert [x for y in a for x in y] == whole_a
        assert [x for y in b for x in y] == whole_b or not pair.same_bytes(" " + text, whole_a, whole_b)


def test_odd_rows(spark, pair, monkeypatch):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice(ODD) for _ in range(rng.randint(1, 40)))) for k in range(120)] + [(None, "no id"), (None, None), (500, ""), (501, " "), (502, "a▁b"), (7, "again"), (7, "again"), (503, "x" * 30_000), (504, "the end " * 4_000)]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_a int, chunk string").repartition(3)
    got = ta.align_documents(docs, A, B).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(pair, rows)
    assert ta.align_documents(docs.limit(0), A, B).collect() == []


def test_small_chunks_give_the_same(pair):
    """Chunks, and parts forgotten between them, change nothing."""
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choice(["the", "then", "éa", "x1", "<s>", "a▁"]) for _ in range(rng.randint(0, 30)))) for k in range(60)]
    worker = ta.Parts(pair)
    parts = []
    for k in range(0, 60, 7):
        worker.clear()
        found = ta._chunk(worker, [t for _, t in rows[k : k + 7]])
        parts += zip(*[found[c].tolist() for c in ("n_a", "n_b", "n_groups", "n_links", "n_shared")], found["groups_sha256"])
    want = {r[0]: (*r[1:6], r[8]) for r in by_hand(pair, rows)}
    assert parts == [want[k] for k in range(60)]


def test_op13(spark, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op13_token_alignment"](spark, SF).select(COLUMNS).collect()
    assert sorted((tuple(r) for r in got), key=repr) == by_hand(pair, rows)
