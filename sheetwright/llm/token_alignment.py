"""Alignment of two tokenizers' tokens over the same bytes, by products of incidence matrices.

Tokens x bytes is a sparse matrix in hand-built CSR. The row products A.B' (Gustavson) give the pairs of tokens
that share bytes, with how many; the ends that both tokenizers share cut the bytes into groups, and tokens x groups gives the pairs
that share a group. Over the corpus, documents x pairs is one more such matrix, kept in chunks of rows; the number of documents
that hold a pair comes from its columns, and each document's sums from its product with what the corpus says of each pair.

A text is encoded in parts that begin at places which no token of either tokenizer crosses: at white space after other characters, at
a mark after a letter (checked when they are loaded; else a text is one part). What a part looks like is worked out once a worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .byte_bpe import byte_characters
from .words import kept, segment_sums

#: Documents and characters of a chunk, characters whose parts are looked up together and of new parts encoded at a time, parts and their characters that a worker remembers.
CHUNK_ROWS, CHUNK_CHARS, GROUP_CHARS, LINE_CHARS, KEEP_PARTS, KEEP_CHARS = 4_096, 16_000_000, 1_000_000, 50_000, 300_000, 20_000_000
#: A part begins at a space or new line after other than white space, and at a mark after a Latin letter.
LETTER, MARK = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,;:!?]"
PART_START = re.compile(rf"(?=[ \n])(?<=\S)|(?={MARK})(?<={LETTER})")
#: Parts that can be encoded as lines of one text.
PLAIN = re.compile(r"[ \n]?\S+")
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


@dataclass(frozen=True)
class Csr:
    """A sparse matrix: row i holds data[k] in column cols[k] for k from indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    cols: np.ndarray
    data: np.ndarray
    n_cols: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))


def incidence(of: np.ndarray, n_rows: int, n_cols: int) -> Csr:
    """Rows x columns with a one where row of[k] (ascending) holds column k."""
    return Csr(np.searchsorted(of, np.arange(n_rows + 1)), np.arange(n_cols), np.ones(n_cols, np.int64), n_cols)


def transposed(of: np.ndarray, n_rows: int) -> Csr:
    """The transpose of incidence(of, n_rows, len(of)): each row holds one column."""
    return Csr(np.arange(len(of) + 1), of, np.ones(len(of), np.int64), n_rows)


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 and so on, counts[i] of them, one run after the other."""
    ends = counts.cumsum()
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """The symbolic pass: for each row of a the entries of b's rows that it meets, repeats counted."""
    met = np.concatenate([[0], np.diff(b.indptr)[a.cols].cumsum()])
    return met[a.indptr[1:]] - met[a.indptr[:-1]]


def gustavson(a: Csr, b: Csr) -> Csr:
    """a times b, row by row: each entry of a row of a adds its multiple of a row of b; equal columns of a row add up."""
    counts = np.diff(b.indptr)[a.cols]
    at = _spread(b.indptr[a.cols], counts)
    key, values = np.repeat(a.rows, counts) * b.n_cols + b.cols[at], np.repeat(a.data, counts) * b.data[at]
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, values = key[order], values[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(values, first) if len(first) else values[:0]
    rows = key[first] // max(1, b.n_cols)
    return Csr(np.searchsorted(rows, np.arange(len(a.indptr))), key[first] - rows * b.n_cols, sums, b.n_cols)


def _sum_by(key: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, ascending, and the sum of each one's weights."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]


@dataclass(frozen=True)
class Aligned:
    """Two token sequences over the same bytes: token spans as ends, group ends, overlaps (A x B, bytes shared)."""

    a_ends: np.ndarray
    b_ends: np.ndarray
    group_ends: np.ndarray
    overlap: Csr
    a_group: Csr
    group_b: Csr

    def shared(self) -> Csr:
        """A x B: tokens of the same group."""
        return gustavson(self.a_group, self.group_b)


def align_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> Aligned:
    """Alignment of two tokenizations of the same bytes; ends ascend, and both last ones are the number of bytes."""
    n = int(a_ends[-1]) if len(a_ends) else 0
    place = np.arange(n)
    overlap = gustavson(incidence(np.searchsorted(a_ends, place, "right"), len(a_ends), n), transposed(np.searchsorted(b_ends, place, "right"), len(b_ends)))
    groups = np.intersect1d(a_ends, b_ends, assume_unique=True)
    a_group = transposed(np.searchsorted(groups, a_ends), len(groups))
    return Aligned(a_ends, b_ends, groups, overlap, a_group, incidence(np.searchsorted(groups, b_ends), len(groups), len(b_ends)))


class Pair:
    """Both tokenizers in one worker. A encodes space + text, B text, which adds the space; special strings are plain text."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        back = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = b"".join(back.get(c, c.encode()) for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = ([str(i) for i in range(len(side))] for side in (self.a_bytes, self.b_bytes))
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        split, plain = spec.get("pre_tokenizer") or {}, "a  b c \n d "
        self.in_parts = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and spec.get("normalizer") is None and all(t["special"] for t in spec["added_tokens"])
            and not any(re.search(rf"[^▁]▁|\n|{LETTER}{MARK}", p) for p in pieces) and b"".join(self.b_bytes[i] for i in self.b.encode(plain)) == f" {plain}".encode()
        )

    def parts(self, text: str) -> list[str]:
        return PART_START.split(f" {text}") if self.in_parts else [f" {text}"]

    def encode_b(self, parts: list[str]) -> list[list[int]]:
        """B's ids of each part. A new line before it takes the space that B adds, and no token crosses it."""
        if not self.in_parts:
            return self.b.encode([p[1:] for p in parts], num_threads=1)
        return [ids[2:] for ids in self.b.encode([f"\n{p}" for p in parts], num_threads=1)]

    def encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of each part."""
        return [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)], self.encode_b(parts)

    def same_bytes(self, part: str, a: list[int], b: list[int]) -> bool:
        wanted = part.encode("utf-8", "surrogatepass")
        return b"".join(map(self.a_bytes.__getitem__, a)) == wanted == b"".join(map(self.b_bytes.__getitem__, b))

    def encode_lines(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """A's and B's ids of all parts, each on a line of its own, without the new lines; None if the bytes differ."""
        text = "\n" + "\n".join(parts)
        a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode([text], num_threads=1)[0][1:]
        if not self.same_bytes(text, a, b):
            return None
        sizes = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        lines = np.concatenate([[0], (sizes + 1).cumsum()[:-1]])
        out = []
        for ids, lens in ((a, self.a_len), (b, self.b_len)):
            ids = np.array(ids, np.int64)
            size = lens[ids]
            line = np.isin(size.cumsum() - size, lines, assume_unique=True)
            if int((size[line] == 1).sum()) != len(parts):
                return None
            out.append(ids[~line])
        return tuple(out)


class Parts:
    """What a worker knows of the parts it has met: counts, text of the groups, linked id pairs (A id << 32 | B id) with their number."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.text: list[str] = []
        self.chars = 0
        self.counts = np.zeros((1024, len(COUNTS) + 1), np.int64)  # the last one: whether both give the part's bytes
        self.links = [np.zeros(1, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)]  # ends by part, codes, times

    def full(self) -> bool:
        return len(self.ids) > KEEP_PARTS or self.chars > KEEP_CHARS

    def parts_by_pairs(self, parts: np.ndarray) -> tuple[Csr, np.ndarray]:
        """Some parts x the id pairs linked in them, and the pairs' codes."""
        ends, codes, times = self.links
        counts = ends[parts + 1] - ends[parts]
        at = _spread(ends[parts], counts)
        names, column = np.unique(codes[at], return_inverse=True)
        return Csr(np.concatenate([[0], counts.cumsum()]), column, times[at], len(names)), names

    def learn(self, parts: list[str]) -> None:
        new, size = [], 0
        for part in {*parts}.difference(self.ids):
            new.append(part)
            size += len(part)
            if size >= LINE_CHARS:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)

    def _learn(self, new: list[str]) -> None:
        pair = self.pair
        plain = [p for p in new if PLAIN.fullmatch(p)] if pair.in_parts else []
        found = pair.encode_lines(plain) if plain else None
        if found is None:
            plain = []
        rest = [p for p in new if p not in {*plain}] if len(plain) < len(new) else []
        new, sides, good = plain + rest, list(found or ()), [True] * len(plain)
        if rest:
            a, b = pair.encode(rest)
            same = [pair.same_bytes(p, x, y) for p, x, y in zip(rest, a, b, strict=True)]
            flat = [np.array([i for ids, ok in zip(side, same, strict=True) if ok for i in ids], np.int64) for side in (a, b)]
            sides = [np.concatenate(x) for x in zip(sides, flat, strict=True)] if plain else flat
            good += same
        a_ids, b_ids = sides
        size = np.fromiter((len(p.encode("utf-8", "surrogatepass")) if ok else 0 for p, ok in zip(new, good, strict=True)), np.int64, len(new))
        # all parts on one axis of bytes: each part's end is an end of both, so that no link and no group crosses it
        al = align_ends(pair.a_len[a_ids].cumsum(), pair.b_len[b_ids].cumsum())
        ends = np.concatenate([[0], size.cumsum()])
        a_to, b_to, g_to = (np.searchsorted(e, ends, "right") for e in (al.a_ends, al.b_ends, al.group_ends))
        l_to = al.overlap.indptr[a_to]
        shared = np.concatenate([[0], product_sizes(al.a_group, al.group_b).cumsum()])[a_to]
        lo = len(self.ids)
        while lo + len(new) > len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.counts[lo : lo + len(new)] = np.stack([np.diff(a_to), np.diff(b_to), np.diff(g_to), np.diff(l_to), np.diff(shared), np.array(good, np.int64)], axis=1)
        self.ids.update(zip(new, range(lo, lo + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self._keep_text(a_ids, b_ids, al, g_to.tolist())
        self._keep_links(np.repeat(np.arange(len(new)), np.diff(l_to)), a_ids[al.overlap.rows] << 32 | b_ids[al.overlap.cols], len(new))

    def _keep_text(self, a_ids: np.ndarray, b_ids: np.ndarray, al: Aligned, g_to: list[int]) -> None:
        a, b = (list(map(names.__getitem__, ids.tolist())) for names, ids in ((self.pair.a_text, a_ids), (self.pair.b_text, b_ids)))
        i, j, groups = 0, 0, []
        for i2, j2 in zip(np.searchsorted(al.a_ends, al.group_ends, "right").tolist(), np.searchsorted(al.b_ends, al.group_ends, "right").tolist(), strict=True):
            groups.append(f"{a[i] if i2 == i + 1 else ','.join(a[i:i2])}|{b[j] if j2 == j + 1 else ','.join(b[j:j2])}")
            i, j = i2, j2
        self.text += [groups[g] if h == g + 1 else ";".join(groups[g:h]) for g, h in zip(g_to, g_to[1:], strict=False)]

    def _keep_links(self, part: np.ndarray, codes: np.ndarray, n: int) -> None:
        """Appends each part's different codes, with how often it has each."""
        order = np.lexsort((codes, part))
        part, codes = part[order], codes[order]
        first = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(codes, prepend=-1) != 0))
        times, at = np.diff(np.append(first, len(codes))), int(self.links[0][-1])
        to = at + len(first)
        for k, values in ((1, codes[first]), (2, times)):
            if to > len(self.links[k]):
                self.links[k] = np.concatenate([self.links[k], np.zeros(max(len(self.links[k]), len(first)), np.int64)])
            self.links[k][at:to] = values
        self.links[0] = np.concatenate([self.links[0], at + np.searchsorted(part[first], np.arange(n), "right")])


def _pair(a_path: str, b_path: str) -> Parts:
    near = lambda path: path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
    return kept(f"aligner|{a_path}|{b_path}", lambda: Parts(Pair(near(a_path), near(b_path))))


def _group(worker: Parts, texts: list[str]) -> tuple[np.ndarray, list[str], Csr, np.ndarray]:
    """Counts and digests of some documents, documents x pairs, and the pairs' codes."""
    if worker.full():
        worker.clear()
    parts = [worker.pair.parts(t) if t else [] for t in texts]
    worker.learn([p for of in parts for p in of])
    sizes = np.array(list(map(len, parts)), np.int64)
    look = worker.ids.__getitem__
    at = np.fromiter((look(p) for of in parts for p in of), np.int64, int(sizes.sum()))
    sums = segment_sums(worker.counts[at], sizes).astype(np.int64)
    good = sums[:, -1] == sizes  # each part's bytes come out the same
    sums[~good] = 0
    to, digests = sizes.cumsum().tolist(), []
    for ok, n, end in zip(good.tolist(), sizes.tolist(), to, strict=True):
        line = ";".join([worker.text[i] for i in at[end - n : end].tolist()]) if ok and n else ""
        digests.append(hashlib.sha256(line.encode()).hexdigest() if line else "")
    of = np.repeat(np.arange(len(texts)), sizes)
    keep, known = good[of], max(1, len(worker.ids))
    held, times = _sum_by(of[keep] * known + at[keep], np.ones(int(keep.sum()), np.int64))
    doc, part = np.divmod(held, known)
    used, part = np.unique(part, return_inverse=True)
    by_pairs, names = worker.parts_by_pairs(used)
    return sums[:, : len(COUNTS)], digests, gustavson(Csr(np.searchsorted(doc, np.arange(len(texts) + 1)), part, times, len(used)), by_pairs), names


def _chunk(worker: Parts, texts: list[str]) -> dict:
    """A chunk's documents: their counts and digests, and documents x pairs as CSR."""
    found, k = [], 0
    while k < len(texts):
        end, size = k, 0
        while end < len(texts) and (end == k or size + len(texts[end]) <= GROUP_CHARS):
            size += len(texts[end])
            end += 1
        found.append(_group(worker, texts[k:end]))
        k = end
    codes, pair = np.unique(np.concatenate([names[m.cols] for _, _, m, names in found]), return_inverse=True)
    counts = np.concatenate([c for c, *_ in found]).T
    return {
        **dict(zip(COUNTS, counts, strict=True)), "groups_sha256": [d for _, ds, *_ in found for d in ds], "codes": codes, "n_docs": np.bincount(pair, minlength=len(codes)),
        "doc_ends": np.concatenate([np.diff(m.indptr) for _, _, m, _ in found]).cumsum(), "pair": pair, "times": np.concatenate([m.data for _, _, m, _ in found]),
    }


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_shared, n_best, count_sum, groups_sha256 of every row.

    n_shared: pairs of tokens of the same group. n_best: links whose id pair is held by as many documents of the
    corpus as any pair of its A id. Texts that are null or empty, or whose bytes a tokenizer doesn't give back,
    have zeros and ''. Null ids and repeated rows are documents of their own; other columns are not read; an
    empty table gives an empty result. A very long text is a chunk of its own.

    What is known of pairs meets the chunks by equality of the pair, each chunk asking once for each of its
    pairs: nothing is broadcast, and a pair that all documents hold is a row a chunk.
    """

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker, n, ids, texts, size = _pair(a_path, b_path), 0, [], [], 0
        task = TaskContext.get().partitionId()

        def made() -> pa.RecordBatch:
            found = _chunk(worker, texts)
            lists = {"ids": pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(id_kind))}
            for name, values in found.items():
                kind = {"groups_sha256": pa.string(), "pair": pa.int32(), "times": pa.int32(), "doc_ends": pa.int32()}.get(name, pa.int64())
                flat = pa.array(values, kind)
                lists[name] = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([f"{task}.{n}"]), **lists})

        id_kind = None
        for batch in batches:
            id_kind = batch.schema.field("id").type
            for k, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                if texts and (size + len(text) > CHUNK_CHARS or len(texts) >= CHUNK_ROWS):
                    yield made()
                    n, ids, texts, size = n + 1, [], [], 0
                ids.append(batch.column("id").slice(k, 1))
                texts.append(text)
                size += len(text)
        if texts:
            yield made()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} array<bigint>" for c in COUNTS)
    chunks = cut(rows.mapInArrow(chunked, f"chunk string, ids array<{kind}>, {longs}, groups_sha256 array<string>, codes array<bigint>, n_docs array<bigint>, doc_ends array<int>, pair array<int>, times array<int>"), "alignment")

    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("codes", "n_docs")).alias("pos", "p")).select("chunk", "pos", F.col("p.codes").alias("code"), F.col("p.n_docs").alias("n_docs"))
    counts = asked.groupBy("code").agg(F.sum("n_docs").alias("count"))
    a_id = F.shiftright("code", 32)
    most = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("most"))
    known = counts.withColumn("a_id", a_id).join(most, "a_id").select("code", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    told = asked.join(known, "code").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "count", "best"))).alias("told"))
    told = told.select(F.col("chunk").alias("told_chunk"), F.transform("told", lambda x: x["count"]).alias("counts"), F.transform("told", lambda x: x["best"]).alias("best"))

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [*COUNTS, "groups_sha256"]
        flat = lambda table, name: table.column(name).combine_chunks().flatten()
        one = {name: flat(left, name) for name in ["ids", *names]}
        ends, pair, times = (flat(left, name).to_numpy() for name in ("doc_ends", "pair", "times"))
        say = {name: flat(right, name).to_numpy() if right.num_rows else np.zeros(0, np.int64) for name in ("best", "counts")}
        of = np.concatenate([[0], ends])
        for name, column in (("n_best", "best"), ("count_sum", "counts")):
            run = np.concatenate([[0], (times.astype(np.int64) * say[column][pair]).cumsum()]) if len(pair) else np.zeros(1, np.int64)
            one[name] = pa.array(run[of[1:]] - run[of[:-1]], pa.int64())
        return pa.table({"id": one.pop("ids"), **one})

    out = chunks.drop("codes", "n_docs").groupBy("chunk").cogroup(told.groupBy("told_chunk")).applyInArrow(summed, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, n_best long, count_sum long")
    return out.select(F.col("id").alias(id_col), *COUNTS, "n_best", "count_sum", "groups_sha256")
