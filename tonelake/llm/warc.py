"""WARC archives and their index: globally ordered capture histories by external merge.

Records are built as text columns and written by Spark's text writer (gzip, the record terminator as line separator),
so archives land wherever Spark can write; they are read back as whole binary files and parsed by Content-Length. A
payload that is stored already is written as a revisit record without it.

Each archive file gives one locally sorted run of index entries. The runs are stored, dealt out by ranges of (URL key,
timestamp, page), and every range merges its parts of the runs with a loser tree: one comparison per level and entry.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.plans.joins import join_back
from tonelake.sources.shared import materialize, new_path

RECORD_END = "\r\n\r\n"
FILE_RECORDS = 4000
#: Inflated bytes that the reader takes in at once, and index entries that a range merges.
PIECE_BYTES = 1 << 22
RANGE_ENTRIES = 250_000
EPOCH = 1704067200  # 2024-01-01: pages carry no capture time, so page n counts as captured n seconds later
#: Ids are taken modulo this many seconds, so that the year keeps four digits.
LATEST = 10**11
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "tag:tonelake,2024:page/"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are eight groups of 20, each four characters."""
    digits = F.sha1(data)
    out = []
    for g in range(8):
        value = F.conv(F.substring(digits, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record(min_bytes: int) -> Column:
    """The text of a record without its terminator."""
    nl = "\r\n"
    page = lambda c: F.concat(F.lit(f"<{NAME}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{nl}Content-Type: text/html; charset=utf-8{nl}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(nl + nl))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), page(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{nl}WARC-Refers-To: "), page(F.col("refers_to")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(nl, *lines), F.lit(nl + nl), block)


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to ``path``.

    Of the rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a response and
    the others revisit it. Null html is an empty payload, a null url an empty one; null page ids come after all others
    and repeated rows of the smallest page_id are all responses. Page ids may be any longs; their capture times repeat
    after LATEST seconds. A very long payload is one record. An empty table writes no records.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), (F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(LATEST)) + EPOCH).alias("captured"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html").cast("binary")))
    first = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    # Of the payloads only digests are shuffled, as long as Spark broadcasts the table of those that repeat.
    rows = join_back(rows, materialize(first, "digests"), ["digest"], "left")
    rows = rows.withColumn("refers_to", F.when((F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))
    rows.select(_record(min_bytes).alias("value")).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


_URL = re.compile(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([^/?#]*))?)?([^?#]*)(?:\?([^#]*))?", re.DOTALL)


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: reversed host, path, sorted query; scheme, user, www., usual ports and fragment go.

    Any text has a key: what does not read as a URL is a path.
    """
    host, port, path, query = (part or "" for part in _URL.match(url.strip()).groups())
    host = host.lower().removeprefix("www.")
    port = "" if port in ("", "80", "443") else ":" + port.lower()
    query = "&".join(sorted(query.split("&"))) if query else ""
    return (host if host.startswith("[") else ",".join(reversed(host.split(".")))) + port + ")" + (path or "/") + ("?" + query if query else "")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header fields and block of each record of an archive that arrives in pieces; one record is held at a time."""
    at, held = 0, bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while held or more():
        seen = 0
        while (head := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not more():
                raise ValueError(f"the archive ends inside a header at {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in held[:head].decode().split("\r\n")[1:])
        end = head + 4 + int(fields["Content-Length"])
        while len(held) < end + 4:
            if not more():
                raise ValueError(f"the archive ends inside the record at {at}")
        yield at, fields, bytes(held[head + 4 : end])
        del held[: end + 4]
        at += end + 4


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file, member by member, PIECE_BYTES at most at a time."""
    while data:
        stream = zlib.decompressobj(31)
        while not stream.eof and data:
            piece = stream.decompress(data, PIECE_BYTES)
            data = stream.unconsumed_tail
            if piece:
                yield piece
        rest = stream.flush()
        if rest:
            yield rest
        data = stream.unused_data


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so the next winner costs one path to the root."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for run in range(self.k):
            self._climb(run)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _climb(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            rival = self.losers[node]
            if rival == -1:  # while the tree is built: wait for the other side
                self.losers[node] = run
                return
            if self._beats(rival, run):
                self.losers[node], run = run, rival
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            run = self.losers[0]
            yield self.heads[run]
            self.heads[run] = next(self.runs[run], None)
            self._climb(run)


INDEX = "url_key string, captured_at string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long"
_FIELDS = [f.split()[0] for f in INDEX.split(", ")]


def _page(name: str) -> int | None:
    text = name.strip("<>").removeprefix(NAME)
    return None if text == "null" else int(text)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of the archives at ``path``; ``run`` and ``place`` number each file's sorted run. Payloads are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                entries = []
                for offset, f, block in records(inflated(content.as_py())):
                    head = block.index(b"\r\n\r\n")
                    payload, kind = block[head + 4 :], f["WARC-Type"]
                    size = int(block[:head].rpartition(b"Content-Length: ")[2])
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{file}: the payload at {offset} does not match its digest")
                    url = f["WARC-Target-URI"]
                    refers = _page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
                    entries.append((url_key(url), f["WARC-Date"], _page(f["WARC-Record-ID"]), url, kind, size, digest, refers, file, offset))
                entries.sort(key=_order)
                columns = list(zip(*entries)) if entries else [[]] * len(_FIELDS)
                kinds = [pa.int64() if t.endswith("long") else pa.string() for t in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, kinds)], pa.array(range(len(entries)), pa.int64())], names=[*_FIELDS, "place"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX + ", place long")


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[8], entry[9]


def index(spark: SparkSession, path: str) -> DataFrame:
    """The merged index of the archives at ``path``, ordered by URL key, timestamp and page over all partitions.

    Null page ids come last, then files and offsets decide; so captures that repeat keep their order. A range holds about
    RANGE_ENTRIES entries, however often a URL was captured. ``offset`` is the place in the inflated file. No archives
    give no entries.
    """
    stored = materialize(runs(spark, path), "runs")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                parts.setdefault(row[8], []).append(row)
        if schema is None:
            return
        # A run's part arrives in pieces; its entries know their places.
        sorted_runs = [[(_order(r), r) for r in sorted(rows, key=lambda r: r[-1])] for rows in parts.values()]
        out: list[tuple] = []
        for _, row in LoserTree(sorted_runs):
            out.append(row[:-1])
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], names=_FIELDS)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], names=_FIELDS)

    n_ranges = max(1, -(-stored.count() // RANGE_ENTRIES))
    ranges = stored.repartitionByRange(n_ranges, "url_key", "captured_at", "page_id", "file", "offset")
    return ranges.mapInArrow(merge, INDEX)


def archive(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write ``pages`` as WARC files, read them back and return their merged index (see write() and index()), one entry
    per row of ``pages``. Other columns are not read."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages.select("page_id", "url", "html"), path, min_bytes)
    return index(spark, path)
