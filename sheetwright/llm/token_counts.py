"""Token counts of whole texts by overlap resynchronisation.

A text is cut into chunks that overlap. Each chunk is encoded by itself with offsets, and
neighbours are spliced inside their overlap at a boundary that both encodings prove stable: a place after white
space that no token crosses, followed by a run of equal tokens at equal offsets. Where none is found
(one very long word, say) the overlap is widened, at last until both chunks are one. Tokens are counted between the splices.

The library encodes each distinct word of a worker once, where the tokenizer's pre-tokenizer never lets a token cross
ASCII white space (checked when the tokenizer is loaded), and else each chunk as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import kept, text_groups

#: Characters of a chunk, of an overlap before it is widened, and equal tokens that prove a boundary.
CHUNK, OVERLAP, AGREE = 4_096, 128, 4
#: Characters whose words are looked up together, and words whose counts and whose tokens a worker remembers (about 100 MB).
GROUP_CHARS, KEEP_COUNTS, KEEP_TOKENS = 1_000_000, 500_000, 40_000
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(f"[^{WHITE_SPACE}]+")


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class WordChunk:
    """text[lo:hi] as encoded by itself: its words, and where asked for their tokens with offsets in the text."""

    def __init__(self, counter: Counter, text: str, lo: int, hi: int):
        self.counter, self.text, self.lo, self.hi = counter, text, lo, hi
        self.words = WORD.findall(text, lo, hi)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.array([m.start() for m in WORD.finditer(self.text, self.lo, self.hi)], dtype=np.int64)

    def _between(self, a: int, b: int) -> tuple[int, int]:
        return (0, len(self.words)) if a <= self.lo and b >= self.hi else tuple(np.searchsorted(self.starts, [a, b]).tolist())

    def count(self, a: int, b: int) -> int:
        """The number of tokens from a to b, both no place inside a word of a neighbour."""
        i, j = self._between(a, b)
        return self.counter.count_words(self.words[i:j])

    def tokens(self, a: int, b: int) -> list[tuple[int, int, int]]:
        """Id, start and end of the tokens of the words that begin from a to b."""
        i, j = self._between(a, b)
        found = self.counter.word_tokens(self.words[i:j])
        return [(t, at + s, at + f) for at, tokens in zip(self.starts[i:j].tolist(), found, strict=True) for t, s, f in tokens]


class TokenChunk:
    """text[lo:hi] as the library encodes it."""

    def __init__(self, counter: Counter, text: str, lo: int, hi: int):
        self.lo, self.hi = lo, hi
        e = counter.encode([text[lo:hi]])[0]
        self.found = [(t, s + lo, f + lo) for t, (s, f) in zip(e.ids, e.offsets, strict=True)]

    def count(self, a: int, b: int) -> int:
        return len(self.tokens(a, b))

    def tokens(self, a: int, b: int) -> list[tuple[int, int, int]]:
        return self.found if a <= self.lo and b >= self.hi else [t for t in self.found if a <= t[1] < b]


class Counter:
    """One tokenizer in one worker, with what it has made of the words it has met."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer = load_tokenizer(path)
        self.chunk, self.overlap = chunk, overlap
        self.counts: dict[str, int] = {}
        self.details: dict[str, list[tuple[int, int, int]]] = {}
        self.by_word = self._white_space_splits(path)

    def _white_space_splits(self, path: str) -> bool:
        """Whether words may be encoded apart: no added token holds white space, and the pre-tokenizer drops it."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
        drops = any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and "\\s" in str(s["pattern"]) for s in steps)
        return drops and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]) and all(
            len(self.tokenizer.encode(f"a{c}b", add_special_tokens=False).ids) == 2 for c in " \t\n\x0b\x0c\r"
        )

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def learn(self, words: list[str]) -> None:
        new = list({*words}.difference(self.counts))
        for k in range(0, len(new), 2_000):
            self.counts.update(zip(new[k : k + 2_000], map(len, self.tokenizer.encode_batch_fast(new[k : k + 2_000], add_special_tokens=False)), strict=True))

    def count_words(self, words: list[str]) -> int:
        try:
            return sum(map(self.counts.__getitem__, words))
        except KeyError:  # a piece of a word that only a widened overlap shows
            self.learn(words)
            return sum(map(self.counts.__getitem__, words))

    def word_tokens(self, words: list[str]) -> list[list[tuple[int, int, int]]]:
        new = list({*words}.difference(self.details))
        if len(self.details) > KEEP_TOKENS:
            self.details, new = {}, list({*words})
        self.details.update((w, [(t, s, f) for t, (s, f) in zip(e.ids, e.offsets, strict=True)]) for w, e in zip(new, self.encode(new), strict=True))
        return [self.details[w] for w in words]

    def chunk_of(self, text: str, lo: int, hi: int) -> WordChunk | TokenChunk:
        return (WordChunk if self.by_word else TokenChunk)(self, text, lo, hi)

    def count(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        parts = [spliced(t, self.chunk_of, self.chunk, self.overlap)[0] for t in texts]
        if self.by_word:
            if len(self.counts) > KEEP_COUNTS:
                self.counts.clear()
            self.learn([w for of in parts for chunk, _, _ in of for w in chunk.words])
        return [sum(chunk.count(a, b) for chunk, a, b in of) for of in parts]


def stable_boundary(text: str, a: list[tuple], b: list[tuple], lo: int, hi: int) -> int | None:
    """A place within text[lo:hi] that both encodings, lists of (id, start, end), prove a common stable boundary."""
    at = {start: k for k, (_, start, _) in enumerate(a) if start > lo}
    for j, (_, start, _) in enumerate(b):
        if start >= hi:
            return None
        i = at.get(start)
        if i is None or text[start - 1] not in WHITE_SPACE:
            continue
        if i and a[i - 1][2] > start or j and b[j - 1][2] > start:
            continue  # a token crosses it
        run = [x for x in a[i : i + AGREE] if x[2] < hi]
        if len(run) == AGREE and run == b[j : j + AGREE]:
            return start
    return None


def spliced(text: str, chunk_of: Callable, chunk: int, overlap: int) -> tuple[list[tuple], int]:
    """The chunks of a text, each with the places from and to which its tokens count; and how often an overlap was widened."""
    parts: list[tuple] = []
    current, begin, widened = chunk_of(text, 0, min(chunk, len(text))), 0, 0
    while current.hi < len(text):
        width, hi = overlap, current.hi
        while True:
            start = hi - width
            if start <= max(begin, current.lo):  # all of it is overlap: both as one, from the last stable place
                following = chunk_of(text, begin, min(len(text), hi + max(chunk, hi - begin)))
                break
            following = chunk_of(text, start, min(len(text), start + max(chunk, 2 * width)))
            place = stable_boundary(text, current.tokens(start, hi), following.tokens(start, hi), start, hi)
            if place is not None:
                parts.append((current, begin, place))
                begin = place
                break
            width, widened = width * 2, widened + 1
        current = following
    return [*parts, (current, begin, len(text))], widened


def resynchronised(text: str, counter: Counter, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], list[tuple[int, int]], int]:
    """Ids and character offsets of text, encoded in overlapping chunks; and how often an overlap was widened."""
    parts, widened = spliced(text, counter.chunk_of, chunk, overlap)
    found = [t for part, a, b in parts for t in part.tokens(a, b)]
    return [t for t, _, _ in found], [(s, f) for _, s, f in found], widened


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, in the input's partitions: no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Null ids and repeated rows pass as they are; other
    columns are not read, so clashing names don't matter; an empty table gives an empty result. Very long
    texts are encoded a chunk at a time.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(f"counter|{tokenizer}|{chunk}|{overlap}", lambda: Counter(tokenizer, chunk, overlap))
        for batch in batches:
            n = [c for texts in text_groups(batch.column("text"), GROUP_CHARS) for c in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
