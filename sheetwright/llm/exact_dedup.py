"""Exact deduplication by an extendible-hash index on shared files, in DataFrame operations alone.

Each text without white space has a 64-bit key. A directory of at most 2**MAX_DEPTH slots maps the leading
bits of a key to its bucket: a bucket with too many rows splits on its next bit, which doubles the directory
where needed. Neighbouring buckets make up an owner, a range of keys of about OWNER_ROWS rows; each row is dealt to its
owner's task, which chains the rows of a bucket by key and compares the bytes of a chain's texts, so colliding
keys are told apart. What the owners find is the index, sorted by key within each owner, in the shared folder.

A key of more than HOT_ROWS rows cannot be split by its bits. Such keys (at most rows / HOT_ROWS of them) are left out of the
buckets: their texts are aggregated as bytes before the shuffle, one row a task and text, and the rows look their text up by its bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import cut

#: The white space that equal texts may differ in.
WHITE_SPACE = " \t\n\x0b\x0c\r"
MAX_DEPTH, BUCKET_ROWS, OWNER_ROWS, HOT_ROWS = 16, 2_500, 5_000, 50_000
#: Hot keys up to which they are broadcast (20 bytes each), bytes of hot keys' texts up to which those are, and parts of their rows beyond that.
BROADCAST_KEYS, BROADCAST_BYTES, SALTS = 500_000, 32 << 20, 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def key_of(norm: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(norm), 64 - key_bits) if key_bits < 64 else F.xxhash64(norm)


def slot_of(key: Column, key_bits: int) -> Column:
    return F.shiftrightunsigned(key, max(0, key_bits - MAX_DEPTH)).cast("int")


def directory(counts: DataFrame, key_bits: int, bucket_rows: int = BUCKET_ROWS, owner_rows: int = OWNER_ROWS) -> DataFrame:
    """slot, bucket, depth, owner: the directory after all splits, at most 2**MAX_DEPTH rows; counts: key, n.

    Splitting stops at the first depth at which a bucket holds bucket_rows rows or fewer, or at MAX_DEPTH, where a
    bucket keeps the rest. Owners are runs of buckets.
    """
    slots = counts.groupBy(slot_of(F.col("key"), key_bits).alias("slot")).agg(F.sum("n").alias("n"))
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(slot, {MAX_DEPTH} - depth)"))
    full = levels.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).filter(f"held <= {int(bucket_rows)} OR depth = {MAX_DEPTH}")
    first = levels.join(full, ["depth", "prefix"]).groupBy("slot", "n").agg(F.min(F.struct("depth", "prefix")).alias("b"))
    book = first.select("slot", "n", F.expr(f"shiftleft(b.prefix, {MAX_DEPTH} - b.depth)").alias("bucket"), F.col("b.depth").alias("depth"))
    before = F.sum("n").over(W.orderBy("bucket").rangeBetween(W.unboundedPreceding, -1))  # over at most 2**MAX_DEPTH rows
    return book.withColumn("owner", F.floor(F.coalesce(before, F.lit(0)) / owner_rows).cast("int")).select("slot", "bucket", "depth", "owner")


def dealt(rows: DataFrame, key_bits: int, bucket_rows: int, owner_rows: int, hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """rows (with a key) in their owners' tasks, with bucket and owner, and apart from them the rows of hot keys, if there are any."""
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n")), "dedup-keys")
    hot = cut(counts.filter(F.col("n") > hot_rows).select("key"), "dedup-hot")
    book = cut(directory(counts.filter(F.col("n") <= hot_rows), key_bits, bucket_rows, owner_rows), "dedup-directory")
    n_hot, held = hot.count(), None
    if n_hot:
        some = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        held, rows = rows.join(some, "key", "left_semi"), rows.join(some, "key", "left_anti")
    small = F.broadcast(book.select("slot", "bucket", "owner"))  # at most 2**MAX_DEPTH rows of 12 bytes
    return rows.withColumn("slot", slot_of(F.col("key"), key_bits)).join(small, "slot").drop("slot").repartition("owner"), held


def best(n_points: str, ident: str) -> list[Column]:
    """The order of a group: most code points first, then the smallest id, null ids last."""
    return [F.desc(n_points), F.asc_nulls_last(ident)]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_rows: int = BUCKET_ROWS, owner_rows: int = OWNER_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """owner, bucket, key, text_sha256, id, n_points, keep_id, group_size, kept: an entry for each row; the table in the shared folder.

    Entries of hot keys have no owner and no bucket.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_points"), normalised(text).alias("norm"))
    rows, hot = dealt(rows.withColumn("key", key_of(F.col("norm"), key_bits)), key_bits, bucket_rows, owner_rows, hot_rows)
    chain = W.partitionBy("key", "bucket", "owner", "norm")  # within the owner's task; texts of one key are compared as bytes
    turn = chain.orderBy(*best("n_points", "id"))
    found = rows.withColumns({"keep_id": F.first("id").over(turn), "kept": F.row_number().over(turn) == 1, "group_size": F.count("*").over(chain)})
    entries = found.select("owner", "bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "id", "n_points", "keep_id", "group_size", "kept")
    if hot is not None:
        entries = entries.unionByName(_hot_entries(hot))
    return cut(entries, "dedup-index")


def _met(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of hot keys with what is known of their texts, by key and bytes; texts: t_key, t_norm and more.

    Texts of BROADCAST_BYTES at most are broadcast. Else the rows of a key are dealt by salt, and its texts go to every salt.
    """
    same = (F.col("key") == F.col("t_key")) & (F.col("norm") == F.col("t_norm"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("t_norm") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(texts), same)
    salted = rows.withColumn("salt", F.pmod("number", F.lit(SALTS)).cast("int"))
    every = texts.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, same & (F.col("salt") == F.col("t_salt"))).drop("salt", "t_salt")


def _hot_texts(rows: DataFrame, *rank: Column) -> DataFrame:
    """t_key, t_norm, b (the least rank), group_size of each text of the hot keys: aggregated as bytes, one row a task and text before the shuffle."""
    texts = rows.groupBy("key", "norm").agg(F.min(F.struct(*rank)).alias("b"), F.count("*").alias("group_size"))
    return cut(texts.select(F.col("key").alias("t_key"), F.col("norm").alias("t_norm"), "b", "group_size"), "dedup-hot-texts")


def _hot_entries(rows: DataFrame) -> DataFrame:
    # numbered once, in the shared folder, so that of rows equal in id and length one is kept
    rows = cut(rows.select("key", "norm", "id", "n_points", F.monotonically_increasing_id().alias("number")), "dedup-hot-rows")
    texts = _hot_texts(rows, (-F.col("n_points")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("number"))
    found = _met(rows, texts)
    return found.select(F.lit(None).cast("int").alias("owner"), F.lit(None).cast("int").alias("bucket"), "key", F.sha2("norm", 256).alias("text_sha256"), "id", "n_points", F.col("b.id").alias("keep_id"), "group_size", (F.col("number") == F.col("b.number")).alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """A row for each document: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; all empty and blank texts are one group. Of equal texts the one with the
    most code points stays, then the smallest id; a null id stays only if its group has no other. Of
    repeated rows with the same id and length exactly one is kept. Other columns are not read. An empty
    table gives an empty result. sizes: those of build_index.
    """
    index = build_index(docs, id_col, text_col, **sizes)
    return index.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64, bucket_rows: int = BUCKET_ROWS, owner_rows: int = OWNER_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever these are called.

    The owners keep the first row of each chained text. Rows of hot keys are ranked by length and id before any
    moves, and only those that win their text are compared.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"c{k}" for k in range(len(names))])
    ident, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    back = [F.col(f"c{k}").alias(n) for k, n in enumerate(names)]
    rows = numbered.withColumns({"key": key_of(normalised(F.col(text)), key_bits), "n_points": F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("long")})
    cold, hot = dealt(rows, key_bits, bucket_rows, owner_rows, hot_rows)
    chain = W.partitionBy("key", "bucket", "owner", "norm").orderBy(*best("n_points", ident))
    kept = cold.withColumn("norm", normalised(F.col(text))).withColumn("turn", F.row_number().over(chain)).filter("turn = 1").select(*back)
    if hot is not None:
        hot = hot.withColumns({"norm": normalised(F.col(text)), "number": F.xxhash64(ident, "n_points")})
        texts = _hot_texts(hot, (-F.col("n_points")).alias("less"), F.col(ident).isNull().alias("no_id"), F.col(ident).alias("id"))
        won = _met(hot, texts).filter((F.col("n_points") == -F.col("b.less")) & F.col(ident).eqNullSafe(F.col("b.id")))
        kept = kept.unionByName(won.dropDuplicates(["key", "norm"]).select(*back))
    return kept
