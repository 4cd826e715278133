"""WARC archives with a two-level capture index.

`write_archive` writes one gzip member per record, so a record can be read by its byte range. Each task writes files of
its own under a new name and reports them with its rows; the rows are stored, so only files of tasks that succeeded count
and a task that runs again does no harm.

`write_index` sorts the captures by reversed-host URL key over the cluster and writes them as compressed blocks, one file
per range of keys; the first key of every block, with its byte range, is the sparse directory. `find` deals requests to the
ranges, binary-searches the directory of a range, and reads and unpacks only the blocks asked for. `read_records` then
reads records by byte range, in file order.

Files are opened through `pyarrow.fs` in the shared folder of the cluster; inputs are read by Spark alone.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tetrarank.llm.common import new_path, small_batches, stored

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed-host key: host labels from the right, then path and query; scheme, user, port and fragment are left out."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return quote(url, safe="/:?&=,)%")
    path = parts.path + ("?" + parts.query if parts.query else "")
    return ",".join(reversed(host.split("."))) + ")" + quote(path or "/", safe="/:?&=,)%+;@~!*'($")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """The bytes of a record, before compression."""
    revisit = refers_to is not None
    block = HTTP % len(payload) + (b"" if revisit else payload)
    name = uuid.UUID(bytes=hashlib.blake2b(f"{page_id} {url} {digest}".encode(), digest_size=16).digest())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>",
            f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(payload)}", f"X-Page-Id: {'' if page_id is None else page_id}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(map(chr, range(33, 127)))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; the payload of a revisit is empty. Raises on a record that is not whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    length = int(headers["Content-Length"])
    if lines[0] != "WARC/1.1" or len(rest) != length + 4:
        raise ValueError("damaged record")
    payload = rest[:length].partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != headers["WARC-Payload-Digest"]:
        raise ValueError("payload does not fit its digest")
    return headers, payload


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of `least` bytes or more the smallest page_id is the response.

    Digests alone decide this; the payloads move only where the list of revisits is too large to be broadcast.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = stored(rows.where(F.octet_length("payload") >= least).select("page_id", "digest"), "warc-heads")
    first = heads.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    revisits = heads.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(
        F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("first").alias("refers_to")).distinct()
    found = stored(revisits, "warc-revisits")
    return rows.join(found, (F.col("digest") == F.col("r_digest")) & F.col("page_id").eqNullSafe(F.col("r_page")), "left").drop("r_page", "r_digest")


CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
CAPTURES = "key string, page_id bigint, file string, offset bigint, length bigint"


def write_archive(records: DataFrame, folder: str, roll: int = 1 << 30) -> DataFrame:
    """Write the records and return their captures (key, page_id, file, offset, length), stored."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out = name = None
        at = 0
        try:
            for batch in small_batches(batches, 200):
                rows = []
                for page_id, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = gzip.compress(_record(page_id, url, payload, digest, refers), 6, mtime=0)
                    out.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CAPTURE, strict=True)], schema=CAPTURE)
        finally:
            if out is not None:
                out.close()

    return stored(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, CAPTURES), "warc-captures")


DIRECTORY = pa.schema([("index", pa.string()), ("first_key", pa.string()), ("first_page", pa.int64()), ("first_file", pa.string()), ("first_offset", pa.int64()), ("at", pa.int64()), ("size", pa.int64())])


def _shards(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def write_index(captures: DataFrame, folder: str, block: int = 1000, shard_rows: int = 100_000) -> DataFrame:
    """Write the sorted captures as compressed blocks and return the sparse directory, stored: one row per block."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name, at, lines, out = f"{uuid.uuid4().hex}.idx", 0, [], None
        entries: list[tuple] = []

        def flush():
            nonlocal at, out
            if out is None:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            packed = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode())
            out.write(packed)
            entries.append((name, *lines[0][:4], at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines.append(row)
                if len(lines) >= block:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries, strict=True), DIRECTORY, strict=True)], schema=DIRECTORY)

    order = ["key", "page_id", "file", "offset"]
    keyed = captures.withColumn("page_id", F.coalesce("page_id", F.lit(_NO_PAGE)))
    ranged = keyed.repartitionByRange(_shards(captures.count(), shard_rows), *order).sortWithinPartitions(*order)
    return stored(ranged.select(*CAPTURE.names).mapInArrow(run, "`index` string, first_key string, first_page bigint, first_file string, first_offset bigint, at bigint, size bigint"), "warc-directory")


_NO_PAGE = -(1 << 63)


def find(requests: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Captures of the requested (key, page_id), looked up through the index. Unknown requests give no row.

    The first key of each index file (a file holds some 100,000 captures) is all that reaches the driver and every task.
    """
    shards = sorted((*r.s, r["index"]) for r in directory.groupBy("index").agg(
        F.min(F.struct("first_key", "first_page", "first_file", "first_offset")).alias("s")).collect())
    starts, names = [s[:2] for s in shards], [s[4] for s in shards]

    @F.pandas_udf("array<string>")
    def shards_of(keys: pd.Series, ids: pd.Series) -> pd.Series:
        # Captures of a repeated page may run over several files, from the end of one that begins before it.
        return pd.Series([names[max(0, bisect.bisect_left(starts, x) - 1):bisect.bisect_right(starts, x)] for x in zip(keys, ids.tolist(), strict=True)], dtype=object)

    asked = requests.select("key", F.coalesce("page_id", F.lit(_NO_PAGE)).alias("page_id")).distinct().withColumn("index", F.explode(shards_of("key", "page_id")))

    def look(key, wanted, blocks):
        store, root = pafs.FileSystem.from_uri(folder)
        blocks = blocks.sort_by("at")
        firsts = list(zip(blocks.column("first_key").to_pylist(), blocks.column("first_page").to_pylist(), strict=True))
        places = list(zip(blocks.column("at").to_pylist(), blocks.column("size").to_pylist(), strict=True))
        by_block: dict[int, set] = {}
        for want in zip(wanted.column("key").to_pylist(), wanted.column("page_id").to_pylist(), strict=True):
            last = bisect.bisect_right(firsts, want) - 1
            first = max(0, bisect.bisect_left(firsts, want) - 1)  # captures of a repeated page may run over several blocks
            for at in range(first, last + 1):
                by_block.setdefault(at, set()).add(want)
        out = []
        if by_block:
            with store.open_input_file(f"{root}/{key[0].as_py()}") as file:
                for at in sorted(by_block):
                    start, size = places[at]
                    for line in zlib.decompress(file.read_at(size, start)).decode().split("\n"):
                        k, page, *rest = line.split("\t")
                        if (k, int(page)) in by_block[at]:
                            out.append((k, None if int(page) == _NO_PAGE else int(page), rest[0], int(rest[1]), int(rest[2])))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CAPTURE, strict=True)], schema=CAPTURE)

    return asked.groupBy("index").cogroup(directory.groupBy("index")).applyInArrow(look, CAPTURES)


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def read_records(captures: DataFrame, folder: str, payloads: bool = True, task_rows: int = 20_000) -> DataFrame:
    """Records read by byte range, in file order: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        file = name = None
        for batch in small_batches(batches, 200):
            rows = []
            for wanted, at, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wanted != name:
                    if file is not None:
                        file.close()
                    file, name = store.open_input_file(f"{root}/{wanted}"), wanted
                head, payload = parse_record(gzip.decompress(file.read_at(size, at)))
                page, refers = head["X-Page-Id"], head.get("X-Refers-To-Page")
                rows.append((int(page) if page else None, head["WARC-Target-URI"], int(head["X-Payload-Length"]),
                             head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"], int(refers) if refers else None,
                             payload if payloads else b""))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, READ, strict=True)], schema=READ)
        if file is not None:
            file.close()

    found = stored(captures.select("file", "offset", "length"), "warc-found")
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), _shards(found.count(), task_rows))
    return found.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(
        run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def key_of(url: str) -> Column:
    return F.pandas_udf(lambda u: u.map(url_key), "string")(F.coalesce(F.col(url).cast("string"), F.lit("")))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write an archive of `pages` (page_id, url, html), index it, and read every page back through the index.

    One row per row of `pages`: page_id, payload_bytes, payload_digest, record_type, refers_to. Null html is an empty payload.
    Rows that repeat the smallest page_id of a payload are responses, too. A null page_id never is what others refer to, a
    null url has the empty key. Extra columns are left out. An empty table gives an empty result.
    """
    folder = new_path(pages.sparkSession, "warc")
    captures = write_archive(with_revisits(pages, least), folder)
    directory = write_index(captures, folder)
    requests = pages.select(key_of("url").alias("key"), F.col("page_id").cast("long").alias("page_id"))
    return read_records(find(requests, directory, folder), folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
