"""WARC archives with revisit records, and their capture index by an external merge.

Pages become WARC/1.1 records, each a gzip member of its own as the format advises, in archives of bounded size, which
Spark's own writer commits (so they may lie in any store it can write; its line end, a zero byte, pads the last member).
Of pages with equal payloads the one with the largest id is a response; the others are revisits that keep the HTTP head
and refer to it. Reading back, each archive gives a run of index entries sorted by URL key and time. The runs are dealt
out by key range and arrive one after the other, each in its order; a task keeps them as packed blocks, of which a loser
tree holds one of each run open, and merges them into capture histories in global order.

Defined results: a null html is an empty payload; a null url has an empty key; a null id is smaller than all ids; exact
repeats of the responding row are responses too; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociq.llm.text import batches
from lociq.session import materialize, new_path, partitions, pick

END = "\r\n\r\n"
#: Bytes of an archive before compression; one record may exceed it.
ARCHIVE = 8_000_000
#: Entries of a packed block of a run.
BLOCK = 256
#: Pages carry no time of capture: page n was captured n seconds after this.
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def captured(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL: reversed host, then path and query, lower-cased."""
    if not url:
        return ""
    try:
        parts = urlsplit(url if "://" in url else f"http://{url}")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def record(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
    """One whole record."""
    payload = html.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END}"
    size = len(head) + (0 if refers_to is not None else len(payload))
    kind = "WARC-Type: response" if refers_to is None else f"WARC-Type: revisit\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    uri = "" if url is None else f"\r\nWARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~%' + chr(39))}"
    return (
        f"WARC/1.1\r\n{kind}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Date: {captured(page_id)}{uri}\r\n"
        f"WARC-Payload-Digest: sha1:{digest(payload)}\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: {size}{END}{head}{html if refers_to is None else ''}{END}"
    ).encode()


def write_archives(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes all pages as WARC archives and returns the archives as read back: (path, content)."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    d = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("sha", F.sha1("html"))
    first = d.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("to"), F.count("*").alias("n")).where("n > 1")
    again = d.select("page_id", "sha").join(first, "sha").where("not page_id <=> to and to is not null").select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "to").distinct()
    todo = d.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "to")
    schema = pa.schema([("value", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archives() -> Iterator[tuple]:
            kept, size = [], 0
            for b in it:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    one = record(*row)
                    kept.append(gzip.compress(one, 6, mtime=0))
                    size += len(one)
                    if size >= ARCHIVE:
                        yield (b"".join(kept),)
                        kept, size = [], 0
            if kept:
                yield (b"".join(kept),)

        yield from batches(archives(), schema, 1)

    # One row is one archive and one file.
    made = todo.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    made.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return read_archives(spark, path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, one gzip member at a time."""
    rest = content
    while rest.strip(b"\0"):
        member = zlib.decompressobj(31)
        one = member.decompress(rest)
        rest = member.unused_data
        stop = one.index(b"\r\n\r\n")
        lines = one[:stop].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, one[stop + 4 : stop + 4 + int(fields["content-length"])]


def _page(urn: str) -> int | None:
    n = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(n) if n else None


def entry(fields: dict[str, str], block: bytes) -> tuple:
    """(url_key, captured, page_id, record_type, payload_bytes, payload_digest, refers_to); a response's payload is measured anew."""
    head, _, payload = block.partition(b"\r\n\r\n")
    said = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    kind = fields["warc-type"]
    size = int(said["content-length"])
    if kind == "response" and (digest(payload) != named or len(payload) != size):
        raise ValueError(f"{fields['warc-record-id']}: payload differs from its digest")
    url = unquote(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    return url_key(url), fields["warc-date"], _page(fields["warc-record-id"]), kind, size, named, _page(fields["warc-refers-to"]) if kind == "revisit" else None


class LoserTree:
    """K-way merge of sorted runs: inner nodes keep the losers, so each output costs one path of comparisons."""

    def __init__(self, runs: list[Iterator[tuple]], key: Callable[[tuple], tuple]):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.now = [next(r, None) for r in runs] or [None]
        self.keys = [None if x is None else key(x) for x in self.now]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node:
            other = self.loser[node]
            if self._before(other, winner):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def _before(self, a: int, b: int) -> bool:
        """a comes before b: an empty node (-1) wins while the tree is built, a finished run loses."""
        if a < 0:
            return True
        if b < 0 or self.keys[a] is None:
            return False
        return self.keys[b] is None or (self.keys[a], a) < (self.keys[b], b)

    def __iter__(self) -> Iterator[tuple]:
        while (w := self.loser[0]) >= 0 and self.now[w] is not None:
            yield self.now[w]
            self.now[w] = next(self.runs[w], None)
            self.keys[w] = None if self.now[w] is None else self.key(self.now[w])
            self._play(w)


_FIELDS = [("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
_FIELDS_SQL = "url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def _packed(rows: Iterator[tuple]) -> Iterator[tuple[int, bytes]]:
    """(run, packed block) of rows (run, position, entry ...) that come run by run."""
    zipper, run, block = zstandard.ZstdCompressor(level=1), None, []
    for row in rows:
        if block and (row[0] != run or len(block) == BLOCK):
            yield run, zipper.compress(pickle.dumps(block))
            block = []
        run = row[0]
        block.append(row[2:])
    if block:
        yield run, zipper.compress(pickle.dumps(block))


def _opened(blocks: list[bytes]) -> Iterator[tuple]:
    """The entries of a run, with one block open at a time."""
    opener = zstandard.ZstdDecompressor()
    for b in blocks:
        yield from pickle.loads(opener.decompress(b))


def captures(archives: DataFrame) -> DataFrame:
    """The capture index of archives(path, content), globally ordered by (url_key, captured, page_id)."""
    spark = archives.sparkSession
    run_schema = pa.schema([("run", pa.int64()), ("position", pa.int64()), *_FIELDS])

    def runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in it:
                for path, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    run = int.from_bytes(hashlib.blake2b(path.encode(), digest_size=7).digest(), "big")
                    for i, e in enumerate(sorted((entry(f, x) for f, x in parse(content)), key=_order)):
                        yield run, i, *e

        yield from batches(rows(), run_schema, 5000)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[int, list[bytes]] = {}
        for run, block in _packed(row for b in it for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            by_run.setdefault(run, []).append(block)
        yield from batches(iter(LoserTree([_opened(by_run[r]) for r in sorted(by_run)], _order)), pa.schema(_FIELDS), 5000)

    local = materialize(archives.mapInArrow(runs, f"run long, position long, {_FIELDS_SQL}"), "cdx")
    dealt = local.repartitionByRange(partitions(spark), "url_key", "captured", "page_id").sortWithinPartitions("run", "position")
    return dealt.mapInArrow(merge, _FIELDS_SQL)
