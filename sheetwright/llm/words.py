"""What a worker keeps: one operator's cache at a time, and per-word numbers, so that documents only gather rows."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

#: Words that a worker remembers.
KEEP_WORDS = 150_000
_WORKER: dict[str, object] = {}


def kept(token: str, make: Callable[[], object]) -> object:
    """The one object that this worker keeps from task to task; whatever another operator has kept goes first."""
    if token not in _WORKER:
        _WORKER.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _WORKER[token] = make()
    return _WORKER[token]


class WordTable:
    """Rows of numbers by token, made by `rows(tokens)` when first met; forgets all beyond `keep` tokens."""

    def __init__(self, rows: Callable[[list[str]], np.ndarray], width: int, keep: int = KEEP_WORDS):
        self.rows, self.width, self.keep = rows, width, keep
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.data = np.zeros((1024, self.width), dtype=np.float32)

    def gather(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The row ids of all tokens of the texts, and the number of tokens of each text. Look rows up in .data at once."""
        if len(self.ids) > self.keep:
            self._clear()
        new = list(set(chain.from_iterable(texts)).difference(self.ids))
        if new:
            lo = len(self.ids)
            if lo + len(new) > len(self.data):
                self.data = np.concatenate([self.data, np.zeros((max(len(self.data), len(new)), self.width), dtype=np.float32)])
            self.data[lo : lo + len(new)] = self.rows(new)
            self.ids.update(zip(new, range(lo, lo + len(new)), strict=True))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        look = self.ids.__getitem__
        return np.fromiter(map(look, chain.from_iterable(texts)), np.int64, int(sizes.sum())), sizes


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of rows; an empty run sums to 0."""
    total = np.concatenate([np.zeros((1, values.shape[1])), values.cumsum(axis=0, dtype=np.float64)])
    ends = sizes.cumsum()
    return total[ends] - total[ends - sizes]


def text_groups(column: pa.Array, most_chars: int, most_rows: int = 500) -> Iterator[list[str]]:
    """The texts of a column in order, nulls empty, in groups of about most_chars characters; a longer text alone."""
    group: list[str] = []
    size = 0
    for value in column:
        text = value.as_py() or ""
        if group and (size + len(text) > most_chars or len(group) >= most_rows):
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
