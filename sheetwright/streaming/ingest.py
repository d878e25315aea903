"""Incremental extraction: new workbooks as they come, each once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamReader

from ..operators.drift import latest_captures
from ..operators.extract import Options, extract, halted
from ..plans.template import Template
from ..sources.grid import CELLS, Workbooks, from_cells
from ..sources.layout import whole
from ..sources.shared import cut, drop
from ..sources.workbooks import ROW, parse_files, split

BINARY = "path string, modificationTime timestamp, length long, content binary"


@dataclass(frozen=True)
class Admission:
    """How much a micro-batch takes: files, and bytes of files at most (a larger file alone); and bytes of files that a worker gets at a time.

    A backlog goes through in as many batches as it needs. most_bytes counts for Parquet files of cells too.
    """

    most_files: int = 10_000
    most_bytes: str = "64g"
    worker_bytes: int = 64 << 20


def ingest(spark: SparkSession, folder: str, templates: list[Template], out: str, checkpoint: str, options: Options = Options(), admission: Admission = Admission(), stop_on_unmatched: bool = False) -> None:
    """Extracts the workbooks that came into folder since the last call; the stream's checkpoint remembers which.

    Long tables are appended below out: values (scalars and list elements), tables and failures, and how each file went (files: path, state). With
    stop_on_unmatched see `go_on`.
    """
    files = _admitted(spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true"), admission).load(folder)
    fresh = files.filter(F.lower("path").rlike(r"\.(xlsx|xls|xlsm|xlsb)$") & ~F.regexp_extract("path", "[^/]+$", 0).startswith("~$")).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:  # a batch of large workbooks is parsed a few at a time
            sizes = pdf["content"].map(len).cumsum()
            for _, few in pdf.groupby(sizes // admission.worker_bytes):
                yield from parse_files(iter([few]))

    _run(fresh.mapInPandas(parse, ROW), lambda batch: split(batch)[0], templates, out, checkpoint, options, stop_on_unmatched)


def ingest_cells(spark: SparkSession, folder: str, templates: list[Template], out: str, checkpoint: str, options: Options = Options(), admission: Admission = Admission(), stop_on_unmatched: bool = False) -> None:
    """The same for Parquet files of cells; a document's cells come in one file."""
    _run(_admitted(spark.readStream.schema(CELLS), admission).parquet(folder), from_cells, templates, out, checkpoint, options, stop_on_unmatched)


def _admitted(reader: DataStreamReader, admission: Admission) -> DataStreamReader:
    """Spark takes one of the two limits: files where they are bounded by number, bytes where not."""
    return reader.option("maxFilesPerTrigger", admission.most_files) if admission.most_files else reader.option("maxBytesPerTrigger", admission.most_bytes)


def _run(stream: DataFrame, books: Callable[[DataFrame], Workbooks], templates: list[Template], out: str, checkpoint: str, options: Options, stop_on_unmatched: bool) -> None:
    def batch(df: DataFrame, number: int) -> None:
        spark, kept = df.sparkSession, f"{out}/batches/{number}"
        df.write.mode("overwrite").parquet(kept)
        found = books(spark.read.parquet(kept))
        if stop_on_unmatched and not file_states(spark, out).filter(f"state = 'halt' AND batch < {number}").isEmpty():
            _write(found.docs.select("path", "doc_id", F.lit("held").alias("state")), out, "files", number, 0)
        else:
            _extract(found, templates, options, out, number, 0, stop_on_unmatched)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _extract(books: Workbooks, templates: list[Template], options: Options, out: str, number: int, again: int, stop_on_unmatched: bool) -> None:
    """A batch's results; one that is tried again writes the same places, and counts once its files are listed.

    Its cells are laid out by document first, so that what follows shuffles none of them, and no document is sent through the driver.
    """
    books = books.stored()
    e = extract(books, templates, options)
    states = books.docs.select("path", "doc_id", F.lit("done").alias("state"))
    if stop_on_unmatched:
        upto = halted(e.resolved, books.docs).select("doc_id", "halted")
        states = books.docs.join(whole(upto), "doc_id", "left").select("path", "doc_id", F.when(F.col("halted"), "halt").when(F.col("halted").isNull(), "held").otherwise("done").alias("state"))
    states = cut(states, "ingest-files")
    here = states.filter("state <> 'held'").select("doc_id")
    for name, rows in (("values", e.sliced.filter("shape IN ('scalar', 'list')").drop("columns")), ("tables", e.tables()), ("failures", e.failures())):
        _write(rows.join(whole(here), "doc_id", "left_semi") if stop_on_unmatched else rows, out, name, number, again)
    _write(states, out, "files", number, again)
    drop(books.cells, books.docs, books.sheets, states, e.resolved, e.narrow)  # the batch itself is kept as it came


def _write(rows: DataFrame, out: str, name: str, number: int, again: int) -> None:
    rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}/again={again}")


def file_states(spark: SparkSession, out: str) -> DataFrame:
    """path, doc_id, state (done, halt or held), batch, again of each file, as it stands: its last attempt counts."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/files")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string, doc_id string, state string, batch long, again long")
    rows = spark.read.parquet(f"{out}/files").withColumns({"batch": F.col("batch").cast("long"), "again": F.col("again").cast("long")})
    return rows.groupBy("path", "doc_id").agg(F.max(F.struct("batch", "again", "state")).alias("last")).select("path", "doc_id", "last.state", "last.batch", "last.again")


def go_on(spark: SparkSession, templates: list[Template], out: str, books: Callable[[DataFrame], Workbooks] = from_cells, options: Options = Options()) -> str | None:
    """Continues after a halt: the file that stopped the stream and those held back since are done, again or at last, with these templates.

    A stream that runs with stop_on_unmatched stops at the first file, by path, of a batch that follows no version: what comes before is
    extracted, the file's failure is written, and it and all later files are held back. That state lies with the results, so that a batch tried again finds it as it
    was. Here they go through in path order up to the next such file, which is returned and stops the stream again; None if there is none.
    """
    waiting = cut(file_states(spark, out).filter("state <> 'done'"), "ingest-waiting")
    if waiting.isEmpty():
        return None
    every = file_states(spark, out)
    number = every.agg(F.max("batch")).first()[0]
    again = every.filter(F.col("batch") == number).agg(F.max("again")).first()[0] + 1
    batches = [r.batch for r in waiting.select("batch").distinct().collect()]  # a number for each micro-batch since the halt
    cells = spark.read.parquet(*[f"{out}/batches/{n}" for n in batches])
    _extract(books(cells.join(whole(waiting.select("doc_id")), "doc_id", "left_semi")), templates, options, out, number, again, True)
    return file_states(spark, out).filter("state = 'halt'").agg(F.min("path")).first()[0]


def results(spark: SparkSession, out: str, name: str) -> DataFrame:
    """values, tables or failures of all files so far. Of a file that was done again only the last attempt's rows: its earlier failure goes."""
    rows = spark.read.parquet(f"{out}/{name}").withColumns({"batch": F.col("batch").cast("long"), "again": F.col("again").cast("long")})
    return rows.join(whole(file_states(spark, out).select("doc_id", "batch", "again")), ["doc_id", "batch", "again"], "left_semi").drop("again")


def upsert_captures(spark: SparkSession, store: str, captures: DataFrame) -> None:
    """Replaces a template version's fingerprints by a newer capture; captures: schema, version, captured_at and more.

    What the store holds of a later time stays, so that captures may come in any order, and again: the store is the same.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    newest = latest_captures(captures)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        kept = spark.read.schema(newest.schema).parquet(store).groupBy("schema", "version").agg(F.max("captured_at").alias("held_at"))
        newest = newest.join(kept, ["schema", "version"], "left").filter("held_at IS NULL OR captured_at >= held_at").drop("held_at")
    newest = cut(newest, "captures")  # what is read is not what is written over
    newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema", "version").parquet(store)


def keep_captures(spark: SparkSession, folder: str, schema: str, store: str, checkpoint: str, admission: Admission = Admission()) -> None:
    """Takes the captures (Parquet files of this schema) that came into folder since the last call into the store, batch by batch."""
    stream = _admitted(spark.readStream.schema(schema), admission).parquet(folder)
    stream.writeStream.foreachBatch(lambda df, _: upsert_captures(df.sparkSession, store, df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
