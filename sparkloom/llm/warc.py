"""WARC archives and globally ordered capture histories by external index merge.

1. Pages are grouped by payload digest (reduced before the shuffle, so that a payload that a third of all pages
   share is one row from each task); the largest page_id of a digest is its response, others revisit it. Digests that
   come more than once are a table of their own, without payloads; where it is small enough for Spark's broadcast
   threshold the payloads stay where they lie, else they are joined with it by digest, hot ones split.
2. Tasks stream records, a gzip member each, into archives in the shared folder. A file counts only when its
   task's row is in the manifest table, so files of lost or repeated attempts are never read.
3. Tasks read the archives back in sequence, check payloads against their digests, and store each archive's
   captures as locally sorted runs (at most `run_rows` captures each).
4. The runs are dealt out by ranges of (URL key, timestamp, page_id); every range merges its parts of the runs
   with a loser tree. Ranges hold about `range_rows` captures; equal URLs split at their timestamps.

Edges: a null html is an empty payload; a null url has the key ''; a null page_id is never referred to and sorts
first; rows that share the largest page_id and the payload are all responses; empty tables give no rows; any
payload bytes, CR LF CR LF included, are framed by their length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import _common as C

_EPOCH = datetime(2024, 1, 1)
CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long, length long"


@dataclass(frozen=True)
class Parameters:
    least_payload: int = 0  # bytes from which equal payloads are revisits
    archive_bytes: int = 256 << 20  # compressed size at which a task starts another archive
    level: int = 4
    run_rows: int = 100_000
    range_rows: int = 100_000


class LoserTree:
    """Of k sorted runs' heads the least, found by replaying one path of k matches' losers."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            a, b = (a, b) if self._before(a, b) else (b, a)
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def url_key(url: str) -> str:
    """Host labels in reverse order, then the rest: captures of a site stand together."""
    _, found, rest = url.partition("://")
    rest = rest if found else url
    cut = re.search(r"[/?#]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "/")
    return ",".join(reversed(host.lower().split("."))) + ")" + path


def capture_time(page_id: int | None) -> datetime:
    """The pages carry no time of capture: theirs is the id in seconds."""
    return _EPOCH + timedelta(seconds=(page_id or 0) % 10**8)


def _clean(uri: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)


def record(name: str, page_id: int | None, url: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: int | None, first_url: str | None) -> bytes:
    """A response, or, where payload is None, a revisit, whose HTTP head tells the full payload's length, and its fields
    the URL and time of the response. name is unlike that of any other record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"]
    lines += [f"WARC-Date: {capture_time(page_id):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if payload is None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-Id: {refers_to}", f"WARC-Refers-To-Date: {capture_time(refers_to):%Y-%m-%dT%H:%M:%SZ}"]
        if first_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_clean(first_url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def resolve(pages: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """(page_id, url, html, n_bytes, digest, refers_to, first_url); html is null on revisits; refers_to and first_url,
    the response's, are null on responses."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.sha1(html.cast("binary")).alias("digest"))
    keepers = rows.groupBy("digest", "n_bytes").agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.count("*").alias("n"))
    keepers = keepers.where(F.col("n") > 1).select("digest", "n_bytes", F.col("keeper.page_id").alias("keeper"), F.col("keeper.url").alias("keeper_url"), F.lit(True).alias("shared"))
    same = rows.join(C.written(keepers, "shared-payloads"), ["digest", "n_bytes"], "left")
    again = (F.col("n_bytes") >= p.least_payload) & F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    same = same.withColumn("again", again)
    return same.select("page_id", "url", F.when(~F.col("again"), F.col("html")).alias("html"), "n_bytes", "digest", F.when(F.col("again"), F.col("keeper")).alias("refers_to"), F.when(F.col("again"), F.col("keeper_url")).alias("first_url"))


def write_archives(resolved: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Writes the archives and returns their manifest, itself stored: (archive, n_records, n_bytes)."""
    top = C.fresh_dir(resolved.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = FileSystem.from_uri(top)
        fs.create_dir(folder, recursive=True)
        out, done, name, n, size = None, [], "", 0, 0

        def member(data: bytes) -> bytes:
            pack = zlib.compressobj(p.level, zlib.DEFLATED, 31)
            return pack.compress(data) + pack.flush()

        for batch in C.sliced(batches, "html"):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{folder}/{name}")
                page_id, url, html, n_bytes, digest, refers_to, first_url = row
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                data = member(record(f"{name}/{n}", page_id, url, None if html is None else html.encode(), n_bytes, digest, refers_to, first_url))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= p.archive_bytes:
                    out.close()
                    done.append((f"{top}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{top}/{name}", n, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["archive", "n_records", "n_bytes"])

    return C.written(resolved.mapInArrow(run, "archive string, n_records long, n_bytes long"), "warc-manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, record) of each gzip member of an archive, one at a time."""
    at, data = 0, stream.read(chunk)
    while data:
        unpack, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(unpack.decompress(data))
            if unpack.eof:
                used += len(data) - len(unpack.unused_data)
                data = unpack.unused_data or stream.read(chunk)
                break
            used += len(data)
            data = stream.read(chunk)
            if not data:
                raise ValueError("an archive ends within a record")
        yield at, used, b"".join(parts)
        at += used


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; the block is what Content-Length says, no more and no less."""
    end = data.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in data[:end].decode().split("\r\n")[1:])
    block = data[end + 4 : end + 4 + int(fields["Content-Length"])]
    if data[end + 4 + len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record's length and frame disagree")
    return fields, block


def capture(fields: dict[str, str], block: bytes) -> tuple:
    end = block.index(b"\r\n\r\n")
    payload = block[end + 4 :]
    n_bytes = int(re.search(rb"\r\nContent-Length: (\d+)", block[: end + 2])[1])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != n_bytes or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload and its digest disagree")
    page_id, refers_to = fields.get("Page-Id"), fields.get("Refers-To-Page-Id")
    stamp = re.sub(r"\D", "", fields["WARC-Date"])
    uri = fields.get("WARC-Target-URI")
    return ("" if uri is None else url_key(uri), stamp, None if page_id is None else int(page_id), n_bytes, digest, fields["WARC-Type"], None if refers_to in (None, "None") else int(refers_to))


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0


def read_runs(manifest: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Captures of the archives as locally sorted runs: the columns of CAPTURE, then run and place in it; stored."""
    spec = "run string, place long, " + CAPTURE
    names = [x.split()[0] for x in spec.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in spec.split(", ")]

    def sorted_run(rows: list[tuple]) -> pa.RecordBatch:
        rows.sort(key=_order)
        run = uuid.uuid4().hex
        columns = zip(*((run, i, *row) for i, row in enumerate(rows)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, path = FileSystem.from_uri(archive)
                rows: list[tuple] = []
                with fs.open_input_stream(path) as stream:
                    for at, length, data in members(stream):
                        rows.append((*capture(*parse(data)), archive, at, length))
                        if len(rows) >= p.run_rows:
                            yield sorted_run(rows)
                            rows = []
                if rows:
                    yield sorted_run(rows)

    archives = manifest.select("archive")
    n = max(1, archives.count())  # archives are files of archive_bytes or a task's rest
    return C.written(archives.repartition(n, "archive").mapInArrow(run, spec), "warc-runs")


def merge_runs(runs: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """All captures in the order of URL key, timestamp and page_id, within and across partitions. The shuffle's external
    sort brings each range's parts of the runs one after the other; their heads then play in the loser tree."""
    names = [x.split()[0] for x in CAPTURE.split(", ")]
    n = max(1, -(-runs.count() // p.range_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]  # one range: about range_rows captures
        if not got:
            return
        table = pa.Table.from_batches(got)
        ids = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id")), range(len(ids)), strict=True))
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        heads = [((*_order(key), key[3]) for key in keys[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        order = np.fromiter((x[-1] for x in LoserTree(heads)), np.int64, len(ids))
        yield from table.select(names).take(order).to_batches()

    dealt = runs.repartitionByRange(n, "url_key", "captured", "page_id")
    return dealt.sortWithinPartitions("run", "place").mapInArrow(run, CAPTURE)


def capture_histories(pages: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """Writes the pages' archives, reads them back and returns every capture (CAPTURE) in global order."""
    return merge_runs(read_runs(write_archives(resolve(pages, p), p), p), p)
