"""Exact ranked lexical search: K2-treaps over the grid of terms x documents, descended best-first.

Documents are dealt into chunks; a chunk's grid of terms x documents is a quadtree whose cells hold the largest impact below
them. It is kept as in a K2-tree: one bitmap, four bits a cell, level by level, where a cell's children are found by counting ones, and for
each cell how much its maximum falls short of its parent's, in the narrowest integers. A query's terms are rows. A state is a range of
documents with the cell of each row in it; the weighted sum of their maxima bounds every score in the range, and a range of one
document has its score. States are halved, highest bounds first, until no bound reaches the k-th score; what a query has found in one
chunk prunes the next.

A document's impact for a term does not hold the term's weight, so that rows of common and rare terms may share a cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut
from .token_alignment import _sum_by
from .words import kept

#: Documents and characters of a chunk; terms and bytes of a slice of the vocabulary; queries a part; chunks a group at most; tasks a core.
CHUNK_ROWS, CHUNK_CHARS, SLICE_TERMS, SLICE_BYTES, PART_QUERIES, GROUP_CHUNKS, TASKS = 4_096, 16_000_000, 200_000, 8_000_000, 1_000, 64, 3
#: States that are halved at a time, and cells that they may hold.
STATES, STATE_CELLS = 128, 1_000_000
#: Every byte that is no part of a term as a space, A-Z as a-z.
_FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text, with repeats: maximal runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Treap:
    """A K2-treap of points (row, col) with values above 0; no place twice."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_rows: int, n_cols: int):
        self.height = max(1, int(max(n_rows, n_cols, 2) - 1).bit_length())
        z = np.zeros(len(rows), np.int64)
        for k in range(self.height):
            z |= (rows >> k & 1) << (2 * k + 1) | (cols >> k & 1) << (2 * k)
        order = np.argsort(z)
        cells, most, levels = z[order], values[order].astype(np.int64), []
        for _ in range(self.height):  # from the points up
            above = cells >> 2
            first = np.flatnonzero(np.diff(above, prepend=-1))
            top = np.maximum.reduceat(most, first) if len(first) else most
            parent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(above))))
            levels.append((parent * 4 + (cells & 3), top[parent] - most, len(first)))
            cells, most = above[first], top
        self.root = int(most[0]) if len(most) else 0
        # a cell's place among all is one more than the ones before its bit
        bits, short, at = [], [np.zeros(1, np.int64)], 0
        for place, less, n in reversed(levels):
            bits.append(place + at)
            short.append(less)
            at += 4 * n
        ones = np.concatenate(bits)
        packed = np.zeros(at // 64 + 1, np.uint64)
        np.bitwise_or.at(packed, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        self.bits, self.before = packed, np.concatenate([[0], np.bitwise_count(packed).astype(np.int64).cumsum()])
        short = np.concatenate(short)
        self.short = short.astype(np.min_scalar_type(int(short.max(initial=0))))

    def child(self, cell: np.ndarray, quadrant: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The child of each cell in a quadrant, and its maximum; -1 and 0 where none is, or no cell was."""
        place = np.maximum(cell, 0) * 4 + quadrant
        word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
        there = (cell >= 0) & ((word >> bit & np.uint64(1)) != 0)
        rank = self.before[place >> 6] + np.bitwise_count(word & ((np.uint64(2) << bit) - np.uint64(1)))
        rank = np.where(there, rank, 0)
        return np.where(there, rank, -1), np.where(there, most - self.short[rank], 0)


class Best:
    """The k best documents of a query so far: highest scores, then smallest ids, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def take(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        best = np.lexsort((i, n, -s))[: self.k]
        self.scores, self.ids, self.null = s[best], i[best], n[best]

    def competes(self, bounds: np.ndarray, ids: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Whether a document with such a score, and such an id or a later one, can still come in."""
        if len(self.scores) < self.k:
            return bounds > 0
        last, i, n = self.scores[-1], self.ids[-1], self.null[-1]
        return (bounds > last) | (bounds == last) & ((null < n) | (null == n) & (ids < i))


def descend(treap: Treap, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, null: np.ndarray, best: Best) -> int:
    """Takes into `best` what the chunk has for one query; ids ascend by column, null ones last. Returns the number of states halved."""
    if not len(rows) or not len(ids):
        return 0
    h, most_states = treap.height, max(2, min(STATES, STATE_CELLS // len(rows)))
    level, col, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([int((weights * treap.root).sum())])
    cell, most = np.zeros((1, len(rows)), np.int64), np.full((1, len(rows)), treap.root, np.int64)
    halved = 0
    while len(level):
        first = col << (h - level)
        open_ = first < len(ids)
        open_[open_] = best.competes(bound[open_], ids[first[open_]], null[first[open_]])
        if not open_.all():
            level, col, bound, cell, most = level[open_], col[open_], bound[open_], cell[open_], most[open_]
            if not len(level):
                break
        if len(level) > most_states:  # the highest bounds go first, the deepest of equal ones
            turn = np.lexsort((-level, -bound))
            now, later = turn[:most_states], turn[most_states:]
        else:
            now, later = np.arange(len(level)), np.empty(0, np.int64)
        halved += len(now)
        l, c, x, m = level[now], col[now], cell[now], most[now]
        row_bit = (rows[None, :] >> (h - 1 - l)[:, None] & 1) * 2
        kids = [treap.child(x, row_bit + half, m) for half in (0, 1)]
        l, c = np.concatenate([l + 1, l + 1]), np.concatenate([c * 2, c * 2 + 1])
        x, m = (np.concatenate([kids[0][k], kids[1][k]]) for k in (0, 1))
        b = m @ weights
        done = (l == h) & (b > 0) & (c < len(ids))
        if done.any():
            at = c[done]
            good = best.competes(b[done], ids[at], null[at])
            best.take(b[done][good], ids[at[good]], null[at[good]])
        go = l < h
        level, col, bound = np.concatenate([level[later], l[go]]), np.concatenate([col[later], c[go]]), np.concatenate([bound[later], b[go]])
        cell, most = np.concatenate([cell[later], x[go]]), np.concatenate([most[later], m[go]])
    return halved


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Fixed values: (10^9 tf) div (1000 tf + 20 m), with m = 50 + (50 n N) div L of the document."""
    sizes, of = np.unique(n, return_inverse=True)
    m = 50 + np.array([50 * x * n_docs // n_terms for x in sizes.tolist()], np.int64)[of]  # Python's integers: the product may pass 64 bits
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _flat(table: pa.Table, name: str, k: int) -> np.ndarray:
    return table.column(name)[k].values.to_numpy(zero_copy_only=False)


def postings(docs: DataFrame, vocabulary: list[bytes], offset: int, id_col: str, text_col: str) -> DataFrame:
    """chunk, ids, n (terms of each document), row, term, tf: where terms of the vocabulary (numbered from offset) occur; terms and held: documents by term."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)  # SLICE_BYTES or so
    token = f"lexical|{sent.id if hasattr(sent, 'id') else id(sent)}|{offset}|{len(vocabulary)}"

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        find = kept(token, lambda: {t: k for k, t in enumerate(sent.value)}).get
        task, no, ids, n, found, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def made() -> pa.RecordBatch:
            counts = np.array(list(map(len, found)), np.int64)
            term = np.concatenate([np.empty(0, np.int32), *found]).astype(np.int64)
            width = max(1, len(vocabulary))
            key, tf = _sum_by(np.repeat(np.arange(len(found)), counts) * width + term, np.ones(len(term), np.int64))
            row, term = np.divmod(key, width)
            used, held = np.unique(term, return_counts=True)
            whole = {"ids": pa.concat_arrays(ids).cast(pa.int64()), "n": pa.array(n, pa.int64()), "row": pa.array(row, pa.int32()), "term": pa.array(term + offset, pa.int64()), "tf": pa.array(tf, pa.int64()), "terms": pa.array(used + offset, pa.int64()), "held": pa.array(held, pa.int64())}
            return pa.RecordBatch.from_pydict({"chunk": pa.array([f"{task}.{no}"])} | {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for k, v in whole.items()})

        for batch in batches:
            for k, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                if n and (size + len(text) > CHUNK_CHARS or len(n) >= CHUNK_ROWS):
                    yield made()
                    no, ids, n, found, size = no + 1, [], [], [], 0
                words = terms(text)
                at = np.fromiter(map(find, words, repeat(-1)), np.int32, len(words))
                ids.append(batch.column("id").slice(k, 1))
                n.append(len(words))
                found.append(at[at >= 0])
                size += len(text)
        if n:
            yield made()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(chunked, "chunk string, ids array<long>, n array<long>, row array<int>, term array<long>, tf array<long>, terms array<long>, held array<long>")


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slice_terms: int = SLICE_TERMS, part_queries: int = PART_QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Null and empty texts have no terms: such documents are never found, such items find nothing. Document rows
    with equal ids, or null ones (last of equal scores), are documents of their own. Items of equal id and text are one; of equal id
    and other text, an item each. Ids are integers. Other columns are not read; no documents or items give an empty result.

    Only the items' terms are indexed, a slice of the vocabulary at a time, so that what is sent to the workers is
    bounded. Parts of the items meet groups of chunks on a grid, as whole columns of numbers.
    """
    spark = docs.sparkSession

    def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({t.decode("utf-8", "surrogatepass") for t in terms(x.as_py() or "")}) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("item"), pa.array(found, pa.list_(pa.string()))], ["item_id", "item", "terms"])

    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")).withColumn("item", F.sha2("text", 256))
    asked = cut(asked.dropDuplicates(["item_id", "item"]).select("item_id", "item", "text").mapInArrow(item_terms, "item_id long, item string, terms array<string>").filter("size(terms) > 0"), "lexical-items")
    words = asked.select(F.explode("terms").alias("word")).distinct()
    n_words, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    empty = spark.createDataFrame([], f"item_id long, rank int, {id_col} long, score long")
    if not n_words:
        return empty
    n_slices = max(1, -(-n_words // slice_terms), -(-size // SLICE_BYTES))
    by_slice = words.withColumn("slice", F.pmod(F.xxhash64("word"), F.lit(n_slices)).cast("int"))
    numbered = cut(by_slice.withColumn("no", F.row_number().over(W.partitionBy("slice").orderBy("word")) - 1), "lexical-words")
    chunks = None
    for s in range(n_slices):  # a pass over the documents for each slice of the items' terms; one slice in most cases
        vocabulary = [r.word.encode("utf-8", "surrogatepass") for r in numbered.filter(F.col("slice") == s).orderBy("no").select("word").toLocalIterator()]
        part = cut(postings(docs, vocabulary, s << 32, id_col, text_col).withColumn("slice", F.lit(s)), "lexical-postings")
        chunks = part if chunks is None else chunks.unionByName(part)
    sizes = chunks.filter("slice = 0").select(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("terms"), F.size(F.filter("n", lambda x: x > 0)).alias("docs"))
    n_chunks, n_docs, n_terms = sizes.agg(F.count("*"), F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    if not n_terms:
        return empty
    held = chunks.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.held").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (2 * F.col("df") + 1)))
    known = numbered.withColumn("term", F.shiftleft(F.col("slice").cast("long"), 32) + F.col("no")).join(held, "term").select("word", "term", weight.cast("long").alias("w")).filter("w > 0")
    n_items = asked.count()
    n_parts = -(-n_items // part_queries)
    n_groups = min(n_chunks, max(-(-n_chunks // GROUP_CHUNKS), -(-TASKS * spark.sparkContext.defaultParallelism // n_parts)))
    weighed = asked.select("item_id", "item", F.explode("terms").alias("word")).join(known, "word").groupBy("item_id", "item").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    asking = weighed.select("item_id", "item", F.transform("t", lambda x: x["term"]).alias("terms"), F.transform("t", lambda x: x["w"]).alias("weights"), F.pmod(F.xxhash64("item_id", "item"), F.lit(n_parts)).cast("int").alias("a_part")).withColumn("a_group", each(n_groups))
    visited = chunks.drop("terms", "held").withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(n_groups)).cast("int")).withColumn("part", each(n_parts))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        queries = [(_flat(left, "terms", q), _flat(left, "weights", q), Best(k)) for q in range(left.num_rows)]
        right = right.sort_by([("chunk", "ascending"), ("slice", "ascending")]) if queries else right.slice(0, 0)
        names, at = right.column("chunk").to_pylist(), 0
        while at < len(names):
            end = at
            while end < len(names) and names[end] == names[at]:
                end += 1
            _visit(right, at, end, queries, n_docs, n_terms)
            at = end
        out = {"q": np.repeat(np.arange(len(queries)), [len(b.ids) for *_, b in queries]) if queries else np.empty(0, np.int64)}
        ids, null, scores = (np.concatenate([np.empty(0, kind), *[getattr(b, name) for *_, b in queries]]) for name, kind in (("ids", np.int64), ("null", bool), ("scores", np.int64)))
        return pa.table({"item_id": left.column("item_id").take(pa.array(out["q"])), "item": left.column("item").take(pa.array(out["q"])), "doc_id": pa.array(ids, pa.int64(), mask=null), "score": pa.array(scores, pa.int64())})

    met = asking.groupBy("a_part", "a_group").cogroup(visited.groupBy("part", "group")).applyInArrow(meet, "item_id long, item string, doc_id long, score long")
    turn = F.row_number().over(W.partitionBy("item_id", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return met.withColumn("rank", turn.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", F.col("doc_id").alias(id_col), "score")


def _visit(table: pa.Table, at: int, end: int, queries: list[tuple[np.ndarray, np.ndarray, Best]], n_docs: int, n_terms: int) -> None:
    """Rows at to end of the table are one chunk's postings, a row a slice of the vocabulary."""
    ids = table.column("ids")[at].values
    null = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy()
    n = _flat(table, "n", at)
    order = np.lexsort((values, null))  # columns by ascending id
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    row, term, tf = (np.concatenate([_flat(table, name, j) for j in range(at, end)]) for name in ("row", "term", "tf"))
    known, of, times = np.unique(term, return_inverse=True, return_counts=True)
    if not len(known):
        return
    line = np.empty(len(known), np.int64)  # rows of rare terms first: like ones share cells
    line[np.argsort(times, kind="stable")] = np.arange(len(known))
    treap = Treap(line[of], column[row], impacts(tf, n[row], n_docs, n_terms), len(known), len(order))
    for wanted, weights, best in queries:
        spot = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        there = known[spot] == wanted
        descend(treap, line[spot[there]], weights[there], values[order], null[order], best)
