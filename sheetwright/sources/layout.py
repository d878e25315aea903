"""Tables laid out once by document: bucketed by doc_id and sorted, so that what is keyed by document needs no shuffle of them.

A scan of such a table is partitioned by doc_id. Windows and aggregations whose keys begin with it take that as it is; so do joins of two
laid-out tables, on doc_id and more, inside `by_document`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import COMPILED, new_path, settings

#: Lets a join on (doc_id, sheet, row) use sides that are partitioned by doc_id alone.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
PLACE = ["doc_id", "sheet", "row", "col"]
#: Cells of a bucket, about, where their number is known before.
BUCKET_CELLS = 4_000_000


def laid_out(table: DataFrame, name: str, buckets: int | None = None, dealt: DataFrame | None = None, sort: bool = True) -> DataFrame:
    """The table, written to the shared folder in buckets by doc_id, a file a bucket, each sorted by place; one shuffle.

    buckets: by default the session's number of shuffle partitions. Tables that are to meet without a shuffle need the same number.
    dealt: the laid-out table that this one is made of by keys that begin with doc_id; its buckets are taken over as they lie.
    sort: False leaves the rows of a bucket in the order that they come in, and sorts nothing. Cells are sorted: windows by place then meet them in runs.
    """
    spark = table.sparkSession
    n = dealt.buckets if dealt is not None else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    title, path = f"{name.replace('-', '_')}_{uuid.uuid4().hex}", new_path(spark, name)
    keys = [c for c in PLACE if c in table.columns] if sort else []
    # rows are dealt as buckets are, so that each task writes one file, and needs no sort by bucket; what comes by document already isn't dealt again
    with settings(spark, COMPILED | {"spark.sql.shuffle.partitions": str(n), "spark.sql.maxConcurrentOutputFileWriters": "2"}):
        writer = table.repartition(n, F.col("doc_id")).write.bucketBy(n, "doc_id")
        (writer.sortBy(*keys) if keys else writer).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(title)
    out = spark.table(title)
    out.scratch, out.title, out.buckets = path, title, n
    return out


def buckets_for(spark: SparkSession, cells: int) -> int:
    """How many buckets so many cells are laid out in: BUCKET_CELLS each at most, about, so that a task's windows sort them in memory."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-cells // BUCKET_CELLS))


def whole(table: DataFrame) -> DataFrame:
    """The table as a side of a join that is as large as the collection: it is never broadcast, however small its files are.

    Spark takes a table's size from its files, and sorted ids take up a byte or two there: millions of rows would go through the driver.
    """
    return table.hint("merge")


@contextmanager
def by_document(spark: SparkSession) -> Iterator[None]:
    """What is planned and run inside may join on partitionings by doc_id alone; outside the session's setting holds."""
    with settings(spark, {CO_PARTITION: "false"}):
        yield
