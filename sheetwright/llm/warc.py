"""WARC archives and their capture index, by an external merge of sorted runs.

Pages become WARC records (native columns), written as gzip text files whose line separator is the
record's own end. Each archive is inflated piece by piece and parsed by Content-Length; its captures, sorted by URL key
and time, are one run in the shared folder. Samples of all runs give the bounds of ranges of (URL key, time, id, place),
so a popular URL is split. Each run is read in its order and cut at the bounds into packed pieces, and the task of
a range merges the pieces of its runs, as they lie, with a loser tree.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import batched
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path

LEAST_SHARED = 1000
#: Bytes of payload in an archive at most (but for one larger record), and records a file.
ARCHIVE_BYTES, RECORDS_A_FILE = 64_000_000, 20_000
#: Payloads are packed with others of their class: up to so many bytes, or more than all of these.
CLASSES = (4_000, 32_000, 250_000, 1_000_000)
#: Captures a range, ranges at most, samples a range, and captures a packed piece.
RANGE_ROWS, MOST_RANGES, SAMPLES, PIECE_ROWS = 50_000, 20_000, 8, 2_000
#: Groups of equal payloads up to which they are broadcast (60 bytes each).
BROADCAST_GROUPS = 500_000
#: Captures get a second each from this time on, by id, where the pages have no time.
FIRST_CAPTURE = 1_704_067_200
END = "\r\n"


def decide(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, html, bytes, sha1, response_id: the last is set where the record revisits another.

    Of equal payloads of at least `least` bytes the largest id is the response; rows that share this id
    are all responses, and so are rows of a group without any id. Rows with a null id otherwise revisit.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("sha1"), F.sha2(body, 256).alias("sha256"))
    large = rows.filter(F.col("bytes") >= least).groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    large = cut(large, "warc-groups")
    found = rows.join(F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large, "sha256", "left")
    return found.withColumn("response_id", F.when(~F.col("response_id").eqNullSafe(F.col("page_id")), F.col("response_id"))).drop("sha256")


def record_text(crlf: str = END):
    """The WARC record of a decided row, up to the first of its two closing line ends."""
    date = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(crlf))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("response_id").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(crlf * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit(f"WARC/1.1{crlf}"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", date),
        line("WARC-Target-URI", F.regexp_replace("url", r"\s", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        F.when(again, F.concat(line("WARC-Refers-To", urn(F.col("response_id"))), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}"))).otherwise(""),
        F.lit(f"Content-Type: application/http;msgtype=response{crlf}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(crlf * 2),
        block,
        F.lit(crlf),
    )


def size_class(size: Column) -> Column:
    """How many of CLASSES a payload exceeds."""
    return sum((size > most).cast("int") for most in CLASSES)


def size_classes(pages: DataFrame, body_col: str) -> list[tuple[int, int]]:
    """The classes that have payloads, and the largest payload of each in bytes; at most a row more than CLASSES."""
    size = F.octet_length(F.coalesce(F.col(body_col), F.lit("")))
    found = pages.groupBy(size_class(size).alias("class")).agg(F.max(size).alias("widest")).collect()
    return sorted((r["class"], r["widest"]) for r in found)


def write_archives(decided: DataFrame, path: str, classes: list[tuple[int, int]], records_a_file: int = RECORDS_A_FILE) -> None:
    """One archive or more a task and class, of ARCHIVE_BYTES of payload at most.

    A class's archives are cut by what its largest payload allows, so one page costs the others of its class alone a factor of
    eight, and smaller ones nothing. Each class is a pass over the pages, as its filter goes below the join.
    """
    for of, widest in classes:
        most = max(1, min(records_a_file, ARCHIVE_BYTES // max(1, widest)))
        rows = decided.filter(size_class(F.col("bytes")) == of) if len(classes) > 1 else decided
        rows.select(record_text().alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def surt(url: str) -> str:
    """The sort key of a URL: host reversed by commas, without scheme, www, default port and fragment."""
    try:
        u = urlsplit(url if "://" in url else f"//{url}")
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url
    shown = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{shown}){u.path or '/'}{'?' + u.query if u.query else ''}"


def inflated(content, step: int = 1 << 18) -> Iterator[bytes]:
    """The pieces of a gzip file, a few at a time."""
    unpack = zlib.decompressobj(wbits=31)
    for at in range(0, len(content), step):
        yield unpack.decompress(content[at : at + step])
    yield unpack.flush()


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes, bytes]]:
    """Offset, headers, HTTP head and payload of each record of an archive that comes in pieces; one record is held at a time."""
    held, at, start = bytearray(), 0, 0  # start: how much of what is held has been read

    def upto(size: int) -> bool:
        nonlocal held, start
        while len(held) - start < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            held, start = held[start:] + piece if start else held + piece, 0
        return True

    while upto(1):
        size = 0
        while (top := held.find(b"\r\n\r\n", start + max(0, size - 3))) < 0:
            size = len(held) - start
            if not upto(size + 1):
                raise ValueError(f"record at {at} has no end of its headers")
        headers = dict(x.split(": ", 1) for x in held[start:top].decode().split("\r\n")[1:])
        head, block = top + 4 - start, int(headers["Content-Length"])
        if not upto(head + block + 4) or held[start + head + block : start + head + block + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where its length says")
        begin, end = start + head, start + head + block
        split = held.index(b"\r\n\r\n", begin) + 4
        yield at, headers, bytes(held[begin:split]), bytes(held[split:end])
        at, start = at + head + block + 4, end + 4


CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def capture_runs(archives: DataFrame) -> DataFrame:
    """The captures of each archive (path, content), sorted by URL key, time and id: one run an archive."""

    def ident(urn: str) -> int | None:
        number = urn.removeprefix("<urn:page:").removesuffix(">")
        return None if number == "null" else int(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for offset, h, http, payload in parse(inflated(memoryview(content.as_buffer()))):
                    if h["WARC-Type"] == "response":
                        size, digest, refers = len(payload), hashlib.sha1(payload).hexdigest(), None
                    else:
                        size, digest, refers = int(re.search(rb"Content-Length: (\d+)", http)[1]), h["WARC-Payload-Digest"].removeprefix("sha1:"), ident(h["WARC-Refers-To"])
                    rows.append((surt(h["WARC-Target-URI"]), h["WARC-Date"], ident(h["WARC-Record-ID"]), size, digest, h["WARC-Type"], refers, path.rpartition("/")[2], offset))
                rows.sort(key=order)
                yield from _batches(rows)

    return archives.select("path", "content").mapInArrow(run, CAPTURE)


_FIELDS = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())]


PIECE = [("range", pa.int32()), ("run", pa.string()), ("url", pa.string()), ("time", pa.string()), ("ident", pa.int64()), ("start", pa.int64()), ("packed", pa.binary())]


def _batches(rows: Iterable[tuple], size: int = 5_000) -> Iterator[pa.RecordBatch]:
    for part in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*part, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def order(row: tuple) -> tuple:
    """URL key, time, id with null ids first, then place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[7], row[8]


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a new head replays one path."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [self._next(k) if k < len(runs) else None for k in range(self.size)]
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _next(self, k: int):
        row = next(self.runs[k], None)
        return None if row is None else (order(row), row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None and x is None else y is None or (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._less(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head[1]
            k = self.winner
            self.heads[k] = self._next(k)
            node = (k + self.size) // 2
            while node:
                if self._less(self.losers[node], k):
                    self.losers[node], k = k, self.losers[node]
                node //= 2
            self.winner = k


def range_bounds(runs: DataFrame, range_rows: int = RANGE_ROWS) -> list[tuple]:
    """Places in the order that cut all captures into ranges of about range_rows; at most MOST_RANGES."""
    total = runs.count()
    ranges = min(MOST_RANGES, -(-total // range_rows))
    if ranges < 2:
        return []
    every = max(1, total // (ranges * SAMPLES))
    some = runs.filter(F.pmod(F.xxhash64("archive", "offset"), F.lit(every)) == 0)
    places = sorted(order(tuple(r)) for r in some.toLocalIterator())  # about MOST_RANGES * SAMPLES rows at most
    return [places[k * len(places) // ranges] for k in range(1, ranges) if places]


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The runs, each read in its own order, as one table in global order of URL key, time, id and place."""
    bounds = runs.sparkSession.sparkContext.broadcast(range_bounds(runs, range_rows))
    schema = pa.schema(_FIELDS)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted pieces of runs as bytes, each beside its first row."""
        limits, last = bounds.value, {}
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            starts, into = [], None
            for k, row in enumerate(rows):
                place = order(row)
                if row[7] in last and place < last[row[7]]:
                    raise ValueError(f"run {row[7]} is out of order")
                at, last = bisect.bisect_right(limits, place), {row[7]: place}
                if (row[7], at) != into or k - starts[-1][0] >= PIECE_ROWS:
                    into = (row[7], at)
                    starts.append((k, at))
            out = []
            for (lo, at), (hi, _) in zip(starts, [*starts[1:], (len(rows), 0)], strict=True):
                piece = pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns, schema=schema)
                out.append((at, rows[lo][7], *rows[lo][:3], rows[lo][8], piece.serialize().to_pybytes()))
            columns = zip(*out, strict=True) if out else [[]] * len(PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, PIECE, strict=True)], [n for n, _ in PIECE])

    def merge(table: pa.Table) -> pa.Table:
        runs_of: dict[str, list[tuple]] = {}
        for k, (_, run, url, time, ident, offset) in enumerate(zip(*[c.to_pylist() for c in table.drop_columns("packed").columns], strict=True)):
            runs_of.setdefault(run, []).append(((url, time, ident is not None, ident or 0, offset), k))

        def rows(of: list[tuple]) -> Iterator[tuple]:
            for _, k in sorted(of):  # a run's pieces by their first rows, unpacked when reached
                piece = pa.ipc.read_record_batch(table["packed"][k].as_buffer(), schema)
                yield from zip(*[c.to_pylist() for c in piece.columns], strict=True)

        return pa.Table.from_batches(_batches(LoserTree([rows(of) for _, of in sorted(runs_of.items())])), schema)

    dealt = cut(runs.mapInArrow(pieces, "range int, run string, url string, time string, ident long, start long, packed binary"), "capture-pieces")
    return dealt.repartitionByRange("range").groupBy("range").applyInArrow(merge, CAPTURE)


def archive_pages(pages: DataFrame, id_col: str = "page_id", body_col: str = "html", url_col: str = "url", least: int = LEAST_SHARED, records_a_file: int = RECORDS_A_FILE, range_rows: int = RANGE_ROWS) -> tuple[str, DataFrame]:
    """The folder of the archives written, and the merged index of what is read back from them.

    Index columns: CAPTURE. Null bodies are empty payloads, null URLs have an empty key, null ids come
    back null; repeated rows give a record each. A very long body is an archive of its own, held whole by the task that
    parses it. Other columns are not read. No pages give no archives and an empty index.
    """
    spark = pages.sparkSession
    path, classes = new_path(spark, "warc"), size_classes(pages, body_col)
    if not classes:
        return path, spark.createDataFrame([], CAPTURE)
    write_archives(decide(pages, id_col, body_col, url_col, least), path, classes, records_a_file)
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return path, merge_runs(cut(capture_runs(archives), "capture-runs"), range_rows)
