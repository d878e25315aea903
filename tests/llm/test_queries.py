"""Every registered op query on the smallest tables: against its SQL, or against a plain version of its contract."""

import base64
import hashlib
import os
import zlib

import duckdb
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
from sheetwright.llm import token_counts
from sheetwright.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_ops import WORD, components_by_hand, dedup_by_hand, spans_by_hand, targets_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.fixture(scope="module")
def rows(duck):
    return duck.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


def got(spark, name):
    return entry.queries()[name](spark, SF)


def ordered(found):
    return sorted((tuple(r) for r in found), key=repr)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_all_are_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in QUERIES] and len(QUERIES) == 13 and {*QUERIES, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    mine = got(spark, name)
    duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in duck.description]
    assert sorted(columns) == sorted(mine.columns)
    assert ordered(mine.select(*columns).collect()) == ordered(duck.fetchall())


def test_op1(spark, rows):
    tokenizer = token_counts.load_tokenizer(P.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert ordered(got(spark, "op1_token_counts").select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == ordered(want)
    assert any(len(t or "") > 3 * token_counts.CHUNK for _, t, *_ in rows)


def test_op2(spark, rows):
    assert ordered(got(spark, "op2_exact_dedup").select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == dedup_by_hand(rows)


def test_op4(spark, rows):
    found = {r.doc_id: r for r in got(spark, "op4_language_id").collect()}
    assert len(found) == len(rows)
    right = held = 0
    for i, t, lang, _ in rows:
        r = found[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        if r.held_out and lang and r.lang_pred != "und":
            held, right = held + 1, right + (r.lang_pred == lang)
    assert held > 20 and right >= 0.9 * held


def test_op5(spark, rows):
    found = {r.doc_id: r for r in got(spark, "op5_secret_scan").collect()}
    for i, t, *_ in rows:
        base = spans_by_hand(t)
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        r = found[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*[sum(k == j for _, k, _ in base) for j in range(3)], sha(text.encode()))
        assert {*filter(None, text.split(","))} <= {*r.spans.split(",")}


def test_op6(spark, rows):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        tk = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    want = []
    for i, t, *_ in rows:
        ids = tk.encode_ordinary(t or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert ordered(got(spark, "op6_byte_bpe").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == ordered(want)


def test_op7(spark, rows):
    assert ordered(got(spark, "op7_jaccard_join").select("doc_id", "n_shingles", "component_id").collect()) == components_by_hand(rows)


def test_op9(spark, rows):
    found = got(spark, "op9_mixing").collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    total: dict = {}
    for i, _, _, source in rows:
        total[source] = total.get(source, 0) + size[i]
    want, of = targets_by_hand(total), {i: s for i, _, _, s in rows}
    taken: dict = {}
    for r in found:
        source = of[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == total[source] and abs(r.target - want[source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[source] = taken.get(source, 0) + r.taken
    assert len(found) == len(rows) and all(abs(taken[s] - want[s]) <= 0.5 for s in want)
    assert ordered(r[:5] for r in found) == ordered(r[:5] for r in got(spark, "op9_mixing").collect())


def test_op10(spark, rows):
    found = got(spark, "op10_toxicity").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
