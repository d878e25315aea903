"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Labels come from a bounded sample of the training fold, half of it from each class where there are as many; the
calibration weighs the classes back to their true rate. Its first part yields a lexicon (words and word
beginnings that toxic texts use far more often), its second part the trees, its third the calibration, so
no part judges what it has itself learned. Every document is then scored in its own partition.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..sources.shared import cut
from .words import WordTable, kept, segment_sums, text_groups

#: The bound of the labelled sample, in documents.
TRAIN_DOCS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF = 80, 3, 32, 0.15, 12
LEXICON, STEM = 4_000, (4, 8)
LEAST_DOCS, LEAST_ODDS, DOUBT = 4, 2.5, 2.0
#: Characters whose features are made together.
GROUP_CHARS = 1_000_000
#: Parts of a class's documents in turn: 0 to 4 yield the lexicon, 5 to 7 the trees, 8 and 9 the calibration; and the fewest of a class in the latter two.
PARTS, LEAST_GROW, LEAST_SETTLE = (0, 5, 8, 1, 6, 2, 9, 3, 7, 4), 2, 1
#: Second-person words, and look-alike characters in disguised words.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos ti tuyo tus usted ustedes vosotros".split())
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": ""})
FEATURES = ("lexicon", "stems", "worst", "hits", "disguised_hits", "second", "near_second", "capitals", "shouted", "marks", "repeated_marks", "punctuation", "disguised", "stretched", "word_length", "length")
_STRETCHED = re.compile(r"([^\W\d_])\1\1").search
_EDGE = re.compile(r"^[^\w@$*]+|[^\w@$*]+$")


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def plain(token: str) -> str:
    return _EDGE.sub("", token).lower()


class Featurizer:
    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems = words, stems
        self.openings = {s[: STEM[0]] for s in stems}
        self.table = WordTable(self.rows, 9)

    def weight(self, word: str) -> tuple[float, float]:
        stem = 0.0
        if word[: STEM[0]] in self.openings:
            stem = max(self.stems.get(word[:k], 0.0) for k in range(STEM[0], min(len(word), STEM[1]) + 1))
        return self.words.get(word, 0.0), stem

    def rows(self, tokens: list[str]) -> np.ndarray:
        out = []
        for token in tokens:
            word = token.lower() if token.isalpha() else plain(token)
            odds, stem = self.weight(word)
            inner, hidden = False, 0.0
            if not word.isalpha() and any(c.isalpha() for c in word) and any(c in "013457@$!*" for c in word):
                inner, hidden = True, max(self.weight(word.translate(DISGUISE)))
            upper = 0 if token.islower() else sum(map(str.isupper, token))
            out.append((odds, stem, hidden, word in SECOND, upper, upper > 2 and token.isupper(), inner, _STRETCHED(token) is not None, len(word)))
        return np.array(out, dtype=np.float32).reshape(len(out), 9)

    def features(self, texts: list[str]) -> np.ndarray:
        """One row of FEATURES for each text; an empty text has zeros."""
        split = [t.split() for t in texts]
        ids, sizes = self.table.gather(split)
        w = self.table.data[ids]
        n = np.maximum(sizes, 1)[:, None]
        bad = np.maximum(w[:, 0], np.maximum(w[:, 1], w[:, 2]))
        near = np.zeros(len(ids))
        if len(ids):
            doc = np.repeat(np.arange(len(sizes)), sizes)
            second, toxic = w[:, 3] > 0, bad > 0
            for gap in range(1, 6):  # an insult with a second person at most five words away
                same = doc[gap:] == doc[:-gap]
                near[gap:] = np.maximum(near[gap:], toxic[gap:] & second[:-gap] & same)
                near[:-gap] = np.maximum(near[:-gap], toxic[:-gap] & second[gap:] & same)
        sums = segment_sums(np.column_stack([w, bad > 0, near]), sizes)
        chars = np.array([max(len(t), 1) for t in texts])
        marks = np.array([t.count("!") + t.count("?") for t in texts])
        twice = np.array([t.count("!!") + t.count("??") + t.count("!?") for t in texts])
        commas = np.array([t.count(".") + t.count(",") + t.count(";") + t.count(":") for t in texts])
        ends = sizes.cumsum()
        worst = np.array([bad[e - s : e].max(initial=0) for s, e in zip(sizes, ends, strict=True)])
        return np.column_stack([sums[:, 0] / n[:, 0], sums[:, 1] / n[:, 0], worst, np.log1p(sums[:, 9]), np.log1p(sums[:, 2]), sums[:, 3] / n[:, 0], sums[:, 10] / n[:, 0], sums[:, 4] / chars, sums[:, 5] / n[:, 0], marks / chars, twice / chars, commas / chars, sums[:, 6] / n[:, 0], sums[:, 7] / n[:, 0], sums[:, 8] / n[:, 0], np.log1p(sizes)])


class Trees:
    """Boosted regression trees of logistic loss over binned features."""

    def __init__(self, edges: list[np.ndarray], base: float):
        self.edges, self.base, self.trees, self.least = edges, base, [], LEAST_LEAF

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def _grow(self, x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> dict[int, tuple]:
        node, tree = np.ones(len(x), dtype=np.int64), {}
        for depth in range(DEPTH + 1):
            for k in range(1 << depth, 2 << depth):
                rows = np.flatnonzero(node == k)
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                found = (1e-6, 0, 0)
                if depth < DEPTH and len(rows) >= 2 * self.least:
                    for j in range(x.shape[1]):
                        gs, hs, ns = (np.bincount(x[rows, j], weights=v, minlength=BINS + 1).cumsum() for v in (grad[rows], hess[rows], np.ones(len(rows))))
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        gain[(ns < self.least) | (len(rows) - ns < self.least)] = 0
                        if gain.max() > found[0]:
                            found = (gain.max(), j, int(gain.argmax()))
                if found[0] > 1e-6:
                    tree[k] = found[1:]
                    node[rows] = 2 * k + (x[rows, found[1]] > found[2])
                else:
                    tree[k] = (-1, RATE * g / (h + 1))
        return tree

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        b, f = self.binned(x), np.full(len(y), self.base)
        self.least = int(max(1, min(LEAST_LEAF, y.sum() // 5, (1 - y).sum() // 5)))  # a rare class may have leaves of its own
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            self.trees.append(self._grow(b, y - p, p * (1 - p)))
            f += self._one(self.trees[-1], b)

    @staticmethod
    def _one(tree: dict[int, tuple], b: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(b)), [(1, np.arange(len(b)))]
        while todo:
            k, rows = todo.pop()
            j, v = tree[k]
            if j < 0:
                out[rows] = v
            elif len(rows):
                right = b[rows, j] > v
                todo += [(2 * k, rows[~right]), (2 * k + 1, rows[right])]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.base + sum((self._one(t, b) for t in self.trees), np.zeros(len(b)))


def isotonic(raw: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, prior: float = 0.0, doubt: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (raw score, probability) of the non-decreasing (weighted) least-squares fit, by pooling adjacent violators.

    Each pool is drawn towards the prior as if it held `doubt` more documents, so that a few labels alone prove little.
    """
    weight = np.ones(len(y)) if weight is None else weight
    at = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first raw, last raw
    for r, v, w in zip(raw[at], y[at], weight[at], strict=True):
        blocks.append([float(v * w), float(w), r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    pooled = np.maximum.accumulate([(b[0] + doubt * prior) / (b[1] + doubt) for b in blocks]) if blocks else []
    return np.array([x for b in blocks for x in (b[2], b[3])]), np.repeat(pooled, 2)


class Model:
    """What every task gets: lexicon, trees and calibration; a constant where the labels don't allow more."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], trees: Trees | None, knots: tuple[np.ndarray, np.ndarray], prior: float):
        self.words, self.stems, self.trees, self.knots, self.prior = words, stems, trees, knots, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.interp(self.trees.raw(x), *self.knots).clip(0, 1)


def lexicon(texts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings with their log-odds, at most LEXICON each; texts: text, y. Document frequencies, by one groupBy."""
    n = {r["y"]: r["count"] for r in texts.groupBy("y").count().collect()}
    words = texts.select("y", F.array_distinct(F.transform(F.split("text", r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"^[^\p{L}\p{N}_@$*]+|[^\p{L}\p{N}_@$*]+$", "")))).alias("words"))
    stems = F.array_distinct(F.flatten(F.transform("words", lambda w: F.transform(F.sequence(F.lit(STEM[0]), F.lit(STEM[1])), lambda k: F.when(F.char_length(w) >= k, F.substr(w, F.lit(1), k))))))
    flat = words.select("y", F.explode("words").alias("w"), F.lit(0).alias("kind")).unionByName(words.select("y", F.explode(stems).alias("w"), F.lit(1).alias("kind")))
    odds = F.log((F.col("bad") + 0.5) / (n.get(1, 0) + 1)) - F.log((F.col("good") + 0.5) / (n.get(0, 0) + 1))
    found = flat.filter("w <> ''").groupBy("kind", "w").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")).withColumn("odds", odds).filter((F.col("bad") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    out = [{}, {}]
    for kind in (0, 1):
        for r in found.filter(F.col("kind") == kind).orderBy(F.desc(F.col("bad") * F.col("odds")), "w").limit(LEXICON).collect():
            out[kind][r["w"]] = float(r["odds"])
    return out[0], out[1]


def _features_of(rows: DataFrame, words: dict[str, float], stems: dict[str, float], carry: str) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((words, stems))  # at most 2 * LEXICON entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Featurizer(*shared.value)
        for batch in batches:
            x = np.concatenate([f.features(texts) for texts in text_groups(batch.column("text"), GROUP_CHARS)]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column("y"), batch.column("part"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "part", "x"])

    return rows.mapInArrow(run, carry + ", x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from at most train_docs labelled documents outside the held-out fold, chosen by class and a hash of their ids.

    A class that half of train_docs holds is taken whole, and the other fills up. With fewer than LEAST_GROW of a class
    for the trees or LEAST_SETTLE for the calibration every document gets the share of toxic labels.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    have = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    n = [have.get(0, 0), have.get(1, 0)]
    take = [min(n[k], max(train_docs // 2, train_docs - n[1 - k])) for k in (0, 1)]
    of_class = [known.filter(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(take[k]) for k in (0, 1)]
    turn = F.row_number().over(W.partitionBy("y").orderBy(F.xxhash64("id", F.lit(1)), "id")) - 1  # over at most train_docs rows
    sample = of_class[0].unionByName(of_class[1]).withColumn("part", F.get(F.array(*map(F.lit, PARTS)), F.pmod(turn, F.lit(len(PARTS)))))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")  # at most train_docs rows of 16 bytes
    rows = cut(rows.select("text", "y", "part"), "toxicity-sample")
    words, stems = lexicon(rows.filter("part < 5"))
    got = _features_of(rows.filter("part >= 5").select("y", "part", "text"), words, stems, "y int, part int").toArrow()  # at most train_docs rows of 16 numbers
    y, part = np.array(got["y"].to_pylist(), dtype=float), np.array(got["part"].to_pylist(), dtype=int)
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(y), len(FEATURES))
    order = np.lexsort(tuple(x.T) + (y,))  # the tasks' order doesn't matter
    x, y, part = x[order], y[order], part[order]
    weight = np.where(y == 1, n[1] / max(take[1], 1), n[0] / max(take[0], 1))
    prior = float(np.average(y, weights=weight)) if len(y) else 0.0
    grow, settle = part < 8, part >= 8
    if min(y[grow].sum(), (1 - y[grow]).sum()) < LEAST_GROW or min(y[settle].sum(), (1 - y[settle]).sum()) < LEAST_SETTLE:
        return Model(words, stems, None, (np.zeros(1), np.zeros(1)), prior)
    edges = [np.unique(np.quantile(x[grow, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    trees = Trees(edges, float(np.log(y[grow].mean() / (1 - y[grow].mean()))))
    trees.fit(x[grow], y[grow])
    return Model(words, stems, trees, isotonic(trees.raw(x[settle]), y[settle], weight[settle], prior, DOUBT), prior)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", name: str = "score", keep: bool = False) -> DataFrame:
    """id and score of every row, or with keep all columns and the score; no shuffle.

    Null and empty texts have zero features and get the score that these have. Null ids and repeated rows
    pass as they are; with keep, a column called like `name` must not exist yet. Texts are taken in groups of about
    GROUP_CHARS characters, a longer one alone. An empty table gives an empty result.
    """
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        f = kept(token, lambda: Featurizer(m.words, m.stems))
        for batch in batches:
            got = [m.score(f.features(texts)) for texts in text_groups(batch.column(text_col), GROUP_CHARS)]
            names = batch.schema.names if keep else [id_col]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], [*names, name])

    rows = docs if keep else docs.select(id_col, text_col)
    schema = T.StructType([*(rows if keep else rows.select(id_col)).schema.fields, T.StructField(name, T.DoubleType())])
    return rows.mapInArrow(run, schema)
