"""Chat formatting: examples against a plain expansion, exact round trips, odd rows, a conversation over many partitions."""

import hashlib
import random

import pytest

from sheetwright.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["<s>", "</s>", "[INST]", "[/INST]", "<", "[", "\\", "/", "s>", "INST]", "\n", "", "é😀", "$1", "<\\s>", "[\\\\/INST]", "assistant"]


def escape(text):
    for bracket, rests in (("<", ("s>", "/s>")), ("[", ("INST]", "/INST]"))):
        out, k = "", 0
        while k < len(text):
            if text[k] == bracket:
                j = k + 1
                while j < len(text) and text[j] == "\\":
                    j += 1
                if any(text.startswith(r, j) for r in rests):
                    out += bracket + "\\"
                    k += 1
                    continue
            out += text[k]
            k += 1
        text = out
    return text


def piece(role, text):
    if role == "assistant":
        return escape(text) + "</s>"
    return "[INST]" + escape(role.replace("\\", "\\b").replace("\n", "\\n")) + "\n" + escape(text) + "[/INST]"


def by_hand(rows):
    """conv: examples (text, trained text or None), and turns."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", piece(role or "", text or ""), text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        text, found = "<s>", []
        for k, (_, _, role, p, said) in enumerate(turns):
            text += p
            if role == "assistant":
                found.append((text, escape(said)))
            elif k == len(turns) - 1:
                found.append((text, None))
        out[conv] = (found, [(role, said) for _, _, role, _, said in turns])
    return out


def conversations(seed, n):
    rng = random.Random(seed)
    say = lambda: "".join(rng.choice(ODD) for _ in range(rng.randint(0, 8)))
    return [(c, t, rng.choice(["user", "assistant", "system", "to\\ol\n", None, "<s>"]), rng.choice([say(), say(), None])) for c in range(n) for t in range(rng.randint(1, 7))]


def check(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", start int, piece string").repartition(parts)
    pieces = cf.expand(docs)
    want = by_hand(rows)
    whole = {}
    for r in cf.whole_texts(pieces, cf.examples(pieces)).collect():
        trained = None if r.loss_start is None else r.text[r.loss_start : r.loss_stop]
        assert r.chars == len(r.text) and r.context_chars == (len(r.text) if trained is None else r.loss_start)
        whole.setdefault(r.conv_id, []).append((r.example, r.text, trained))
    assert {c: [(t, l) for _, t, l in sorted(found, key=lambda x: x[0])] for c, found in whole.items()} == {c: found for c, (found, _) in want.items()}
    back = {r.conv_id: r for r in cf.read_back(pieces).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in back.items()} == {c: turns for c, (_, turns) in want.items()}
    for c, (found, turns) in want.items():
        assert back[c].replies == [s for role, s in turns if role == "assistant"]
        assert back[c].formatted_chars == sum(len(t) for t, _ in found) and back[c].n_examples == len(found)


def test_examples_and_round_trip(spark):
    check(spark, conversations(1, 150))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, None, "user", None), (5, None, "user", None), (5, 3, "assistant", None), (6, 1, "assistant", "x"), (6, 1, "assistant", "x"), (7, 0, None, None), (8, 0, "assistant", ""), (9, 0, "user", "y" * 100_000)]
    check(spark, rows)
    assert cf.read_back(cf.expand(spark.createDataFrame([], SCHEMA))).collect() == []


def test_one_conversation_over_many_partitions(spark):
    """Half of all turns belong to one conversation; its pieces lie in several partitions and still follow one another."""
    rng = random.Random(4)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{t}") for t in range(400)] + conversations(2, 100)
    rows = [(c + 2 if k >= 400 else c, t, r, x) for k, (c, t, r, x) in enumerate(rows)]
    check(spark, rows, 8)


@pytest.mark.parametrize("text", ["", "<s>", "<\\s>", "</s></s>", "[INST] [/INST]", "<[/INST]", "[\\INST]\\", "<\\\\/s>"])
def test_escape(spark, text):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(text,)], "t string").select(cf.escaped(F.col("t")).alias("e"), cf.unescaped(cf.escaped(F.col("t"))).alias("b")).first()
    assert r.e == escape(text) and r.b == text


def test_no_python(spark):
    rows = spark.createDataFrame(conversations(3, 5), SCHEMA)
    plan = cf.digests(cf.read_back(cf.expand(rows)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_the_added_conversation(spark):
    from sheetwright.llm.queries import TRICKY

    text = TRICKY[0][3]
    (r,) = cf.digests(cf.read_back(cf.expand(spark.createDataFrame(TRICKY, SCHEMA)))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))


def test_each_reply_has_its_prefix_and_target(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "</s>"), (1, 4, "user", "d")]
    got = cf.expand(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    first = "<s>[INST]user\na[/INST]"
    second = first + "b</s>[INST]user\nc[/INST]"
    third = second + "<\\/s></s>[INST]user\nd[/INST]"
    assert [(r.prefix, r.target) for r in got] == [(first, "b</s>"), (second, "<\\/s></s>"), (third, "")]
    assert [(r.loss_start, r.loss_stop) for r in got] == [(len(first), len(first) + 1), (len(second), len(second) + 5), (None, None)]
