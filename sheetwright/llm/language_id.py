"""Language of code-switched text by a linear-chain conditional random field.

Each word of a text has a hidden language. A word's evidence is the sum of the weights of its features
(whole word if in the lexicon, affixes, inner n-grams); the transitions between neighbouring words are
learned with them, by the gradient of the conditional likelihood from forward-backward. Training chains
join passages of several documents, so switches are seen. The whole text is one chain: it is cut into
blocks whose transfer matrices carry the forward and backward messages over the block ends exactly, so a very
long text costs memory by its words and no approximation.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut
from .words import WordTable, kept, segment_sums, text_groups

#: The bound of the training sample: documents of all languages together (one of each language at least), words of a document, and characters a word.
TRAIN_DOCS, DOC_WORDS, WORD_CHARS = 16_000, 400, 64
#: Documents of a language that are enough, and how many more than wanted are looked at to find them.
LANGUAGE_DOCS, MARGIN = 250, 2.0
HASHED, LEXICON, CHAIN, BLOCK = 1 << 16, 300, 32, 64
EPOCHS, BATCH, RATE, SHRINK = 3, 256, 0.2, 1e-6
UNKNOWN = "und"
#: Characters that are labelled together, fewer with many languages.
GROUP_CHARS = 500_000
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def plain(token: str) -> str:
    """The word without digits and marks around it; empty if it has no letter."""
    return _EDGE.sub("", token).lower()


def _mixed(kind: int, *codes: np.ndarray) -> np.ndarray:
    """A hash below HASHED of a feature's kind and characters."""
    h = np.full(len(codes[0]), 2654435761 * (kind + 1) & 0xFFFFFFFF, dtype=np.uint64)
    for c in codes:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(HASHED)).astype(np.int64)


def feature_ids(words: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed ids of all words' features, and the word that each belongs to.

    Features: the word itself if in the lexicon, its prefixes and suffixes of 1 to 3 characters, its inner trigrams.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts, ends = sizes.cumsum() - sizes, sizes.cumsum()
    ids, owners = [], []
    for k in (1, 2, 3):
        has = np.flatnonzero(sizes >= k)
        ids += [_mixed(k, *[codes[starts[has] + j] for j in range(k)]), _mixed(10 + k, *[codes[ends[has] - k + j] for j in range(k)])]
        owners += [has, has]
    owner = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    inner = np.flatnonzero((at > starts[owner]) & (at + 3 < ends[owner]))
    ids.append(_mixed(20, codes[inner], codes[inner + 1], codes[inner + 2]) if len(inner) else np.empty(0, np.int64))
    owners.append(owner[inner])
    known = [k for k, w in enumerate(words) if w in lexicon]
    ids.append(np.array([zlib.crc32(words[k].encode()) % HASHED for k in known], dtype=np.int64))
    owners.append(np.array(known, dtype=np.int64))
    return np.concatenate(ids), np.concatenate(owners)


class Field:
    """Weights of the hashed features by language, and log transition scores."""

    def __init__(self, languages: list[str], lexicon: frozenset[str]):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((HASHED, n), dtype=np.float32)
        self.transitions = np.zeros((n, n))

    def evidence(self, words: list[str]) -> np.ndarray:
        """Summed feature weights of each word; zeros for a word without letters."""
        ids, owners = feature_ids(words, self.lexicon)
        return np.column_stack([np.bincount(owners, weights=self.weights[ids, j], minlength=len(words)) for j in range(len(self.languages))])

    # training

    def fit(self, chains: np.ndarray, labels: np.ndarray, words: list[str], seed: int = 3) -> None:
        """chains, labels: (chains, CHAIN) of word numbers and language numbers. AdaGrad on the conditional likelihood."""
        n = len(self.languages)
        ids, owners = feature_ids(words, self.lexicon)
        flat = ids[np.argsort(owners, kind="stable")]
        start = np.concatenate([[0], np.bincount(owners, minlength=len(words)).cumsum()])
        seen_w, seen_t, rng = np.full((HASHED, n), 1e-8), np.full((n, n), 1e-8), np.random.default_rng(seed)
        for _ in range(EPOCHS):
            turn = rng.permutation(len(chains))
            for k in range(0, len(turn), BATCH):
                c, y = chains[turn[k : k + BATCH]], labels[turn[k : k + BATCH]]
                used, back = np.unique(c, return_inverse=True)
                spans = [flat[start[u] : start[u + 1]] for u in used]
                sizes = np.fromiter(map(len, spans), np.int64, len(spans))
                feats = np.concatenate(spans) if len(spans) else np.empty(0, np.int64)
                e = segment_sums(self.weights[feats], sizes)[back.reshape(c.shape)]
                marginal, pairs = chain_marginals(e, self.transitions)
                diff = np.eye(n)[y] - marginal
                g_word = np.stack([np.bincount(back.ravel(), weights=diff[..., j].ravel(), minlength=len(used)) for j in range(n)], axis=1)
                owner = np.repeat(np.arange(len(used)), sizes)
                touched, at = np.unique(feats, return_inverse=True)
                g = np.stack([np.bincount(at, weights=g_word[owner, j], minlength=len(touched)) for j in range(n)], axis=1) / len(c)
                g -= SHRINK * self.weights[touched]
                seen_w[touched] += g**2
                self.weights[touched] += RATE * g / np.sqrt(seen_w[touched])
                wanted = np.zeros((n, n))
                np.add.at(wanted, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
                g_t = (wanted - pairs) / len(c)
                seen_t += g_t**2
                self.transitions += RATE * g_t / np.sqrt(seen_t)

    # prediction

    def marginals(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Forward-backward over texts of the given numbers of words; e: log evidence of all words in order."""
        n, total = e.shape[1], len(e)
        if not total:
            return np.zeros((0, n))
        blocks = -(-sizes // BLOCK)
        first = blocks.cumsum() - blocks  # number of each text's first block
        starts = sizes.cumsum() - sizes
        doc = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(total) - starts[doc]
        row, col = first[doc] + within // BLOCK, within % BLOCK
        m = int(blocks.sum())
        x = np.ones((m, BLOCK, n))
        x[row, col] = np.exp(e - e.max(axis=1, keepdims=True))
        filled = np.zeros((m, BLOCK), dtype=bool)
        filled[row, col] = True
        a = np.exp(self.transitions - self.transitions.max())
        transfer = np.broadcast_to(np.eye(n), (m, n, n)).copy()
        for t in range(BLOCK):  # what a block does to a message that enters it
            step = (transfer.reshape(-1, n) @ a).reshape(m, n, n) * x[:, t, None, :]
            step /= step.max(axis=(1, 2), keepdims=True)
            transfer = np.where(filled[:, t, None, None], step, transfer)
        enter, leave = np.ones((m, n)), np.ones((m, n))
        for k in range(1, int(blocks.max())):  # over the block ends of all texts at once
            here = first[blocks > k] + k
            v = np.einsum("ij,ijk->ik", enter[here - 1], transfer[here - 1])
            enter[here] = v / v.max(axis=1, keepdims=True)
        for k in range(int(blocks.max()) - 2, -1, -1):
            here = first[blocks > k + 1] + k
            v = np.einsum("ijk,ik->ij", transfer[here + 1], leave[here + 1])
            leave[here] = v / v.max(axis=1, keepdims=True)
        out = np.empty((m, BLOCK, n))
        v = enter
        for t in range(BLOCK):
            v = np.where(filled[:, t, None], (v @ a) * x[:, t], v)
            v = v / v.max(axis=1, keepdims=True)
            out[:, t] = v
        v = leave
        for t in range(BLOCK - 1, -1, -1):
            out[:, t] *= np.where(filled[:, t, None], v, 1)
            v = np.where(filled[:, t, None], (v * x[:, t]) @ a.T, v)
            v = v / v.max(axis=1, keepdims=True)
        got = out[row, col]
        return got / got.sum(axis=1, keepdims=True)


def chain_marginals(e: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, words, languages) and expected transition counts, of chains of equal length.

    Like at prediction, the first word is entered from a uniform message.
    """
    x, a = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(transitions - transitions.max())
    length = x.shape[1]
    forward, backward = np.empty_like(x), np.empty_like(x)
    v = np.ones_like(x[:, 0])
    for t in range(length):
        v = (v @ a) * x[:, t]
        v /= v.sum(axis=1, keepdims=True)
        forward[:, t] = v
    v = np.ones_like(x[:, 0])
    for t in range(length - 1, -1, -1):
        backward[:, t] = v
        v = (v * x[:, t]) @ a.T
        v /= v.sum(axis=1, keepdims=True)
    marginal = forward * backward
    marginal /= marginal.sum(axis=2, keepdims=True)
    pair = forward[:, :-1, :, None] * a * (x[:, 1:] * backward[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return marginal, pair.sum(axis=(0, 1))


def sample_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int, language_docs: int, seed: int) -> DataFrame:
    """id, lang, text of the training sample: of each language its share of train_docs, language_docs at most, by a hash of the ids.

    Every language of the training fold is in it. A threshold on the hash leaves about MARGIN times the wanted rows
    before they are ranked; a language that this leaves short is ranked whole.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    held = cut(known.groupBy("lang").agg(F.count("*").alias("held")), "language-counts")
    share = max(1, min(language_docs, train_docs // max(1, held.count())))
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000))
    limit = F.when(F.col("held") <= 4 * MARGIN * share, 1_000_000).otherwise(F.ceil(1_000_000 * MARGIN * share / F.col("held")) + 1)
    near = known.join(F.broadcast(held.withColumn("limit", limit)), "lang").filter(draw < F.col("limit"))  # one row a language
    turn = W.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(seed)), "id", F.xxhash64("text"))
    return near.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= share).select("id", "lang", "text")


def training_words(sample: DataFrame, doc_words: int, seed: int) -> DataFrame:
    """id, lang, words: passages of each text, drawn over the whole of it, doc_words words at most; cut where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = [w for t in text.split() if (w := plain(t)) and len(w) <= WORD_CHARS]
                if len(words) > doc_words:
                    parts = -(-doc_words // CHAIN)
                    rng = np.random.default_rng([seed, zlib.crc32(str(ident).encode())])
                    starts = np.sort(rng.integers(0, len(words) // parts - CHAIN + 1, parts) if len(words) // parts > CHAIN else np.zeros(parts, np.int64)) + np.arange(parts) * (len(words) // parts)
                    words = [w for at in starts for w in words[at : at + CHAIN]][:doc_words]
                out.append(words)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(out, pa.list_(pa.string()))], ["id", "lang", "words"])

    kinds = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    return sample.mapInArrow(run, f"id {kinds['id']}, lang {kinds['lang']}, words array<string>")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, language_docs: int = LANGUAGE_DOCS, doc_words: int = DOC_WORDS, seed: int = 3) -> Field | None:
    """Learns every language of the training fold from at most train_docs documents in all and doc_words words of each; None if there is none.

    The driver gets at most train_docs * doc_words words of WORD_CHARS characters (and one document of each language at
    least); the model has HASHED weights a language.
    """
    sample = cut(training_words(sample_of(docs, id_col, text_col, lang_col, train_docs, language_docs, seed), doc_words, seed), "language-sample")
    rows = sorted(((r["id"], r["lang"], r["words"]) for r in sample.toLocalIterator()), key=lambda r: (r[0], r[1], r[2]))
    if not rows:
        return None
    languages = sorted({lang for _, lang, _ in rows})
    number_of = {lang: k for k, lang in enumerate(languages)}
    split = [(number_of[lang], words) for _, lang, words in rows]
    counts: list[Counter[str]] = [Counter() for _ in languages]
    for k, words in split:
        counts[k].update(words)
    lexicon = frozenset(w for c in counts for w, _ in c.most_common(LEXICON))
    number: dict[str, int] = {}
    passages: list[tuple[int, list[int]]] = []
    rng = np.random.default_rng(seed)
    for k, words in split:
        ids = [number.setdefault(w, len(number)) for w in words]
        at = 0
        while at < len(ids):  # passages of mixed lengths, so that chains switch at any place
            n = int(rng.integers(4, 2 * CHAIN))
            passages.append((k, ids[at : at + n]))
            at += n
    rng.shuffle(passages)
    flat = np.array([i for _, ids in passages for i in ids], dtype=np.int64)
    label = np.array([k for k, ids in passages for _ in ids], dtype=np.int64)
    n = len(flat) // CHAIN
    field = Field(languages, lexicon)
    if n:
        field.fit(flat[: n * CHAIN].reshape(n, CHAIN), label[: n * CHAIN].reshape(n, CHAIN), list(number), seed)
    return field


class Labeller:
    """A field in one worker, with the evidence of the words it has met."""

    def __init__(self, field: Field):
        self.field = field
        self.table = WordTable(self._rows, len(field.languages) + 1)

    def _rows(self, tokens: list[str]) -> np.ndarray:
        words = [plain(t) for t in tokens]
        letters = np.array([any(c.isalpha() for c in t) for t in tokens], dtype=np.float32)
        return np.column_stack([self.field.evidence(words), letters])

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all words, whether each has a letter, and the number of words of each text."""
        ids, sizes = self.table.gather([t.split() for t in texts])
        rows = self.table.data[ids].astype(np.float64)
        return self.field.marginals(rows[:, :-1], sizes), rows[:, -1], sizes

    def languages(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language with most of a text's words, and its share of them."""
        marginal, letters, sizes = self.words(texts)
        sums = segment_sums(marginal * letters[:, None], sizes)
        total = sums.sum(axis=1)
        best = sums.argmax(axis=1)
        share = np.divide(sums[np.arange(len(best)), best], total, out=np.zeros(len(best)), where=total > 0)
        return [self.field.languages[b] if n > 0 else UNKNOWN for b, n in zip(best, total, strict=True)], share.clip(0, 1)

    def switches(self, text: str) -> list[tuple[int, int, str]]:
        """Runs of words of one language: start and end in characters, and the language."""
        marginal, letters, _ = self.words([text])
        out: list[tuple[int, int, str]] = []
        for k, m in enumerate(re.finditer(r"\S+", text)):
            lang = self.field.languages[int(marginal[k].argmax())] if letters[k] else (out[-1][2] if out else UNKNOWN)
            if out and out[-1][2] == lang:
                out[-1] = (out[-1][0], m.end(), lang)
            else:
                out.append((m.start(), m.end(), lang))
        return out


def predict(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score of every row; no shuffle.

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing was learned.
    Null ids and repeated rows pass as they are; other columns are not read; an empty table gives an empty result. Texts are taken in
    groups of about GROUP_CHARS characters; a longer text is a group of its own, and costs memory by its words.
    """
    token, group_chars = uuid.uuid4().hex, max(2_000, GROUP_CHARS // (1 + len(field.languages) // 8) if field else GROUP_CHARS)
    shared = docs.sparkSession.sparkContext.broadcast(field)  # HASHED weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = kept(token, lambda: Labeller(shared.value) if shared.value else None)
        for batch in batches:
            lang, score = [], []
            for texts in text_groups(batch.column("text"), group_chars):
                got = labeller.languages(texts) if labeller else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
                lang += got[0]
                score += got[1].tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
