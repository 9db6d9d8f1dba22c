"""WARC archives with a two-level capture index.

Writing: WARC/1.1, one gzip member per record in one archive file per task, in the shared folder,
a warcinfo record first; a task that runs again writes a new file, and only files of finished
tasks are referred to. Record ids follow from file and offset; the page's own id is a field of
its own. The date is a parameter, so that reruns agree.

Index: captures are range-sorted by reversed-host URL key and page id. Every range becomes
one file of zlib-compressed blocks that ends with its sparse block directory (the first key
and place of each block). A lookup bisects the ranges' first keys, then the directory, reads
that block alone, bisects it, and so learns archive, offset and length.

Reading back: found places are sorted by archive and offset, and each record is range-read.

Defined results: a null html is an empty payload; a null or broken URL is keyed by its own
text; of equal payloads of at least `least_revisit` bytes the record of the largest page id
is the response; a page without an absolute URL gets one made of its id; a null page id is smallest; rows that repeat get a record each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import materialize, partitions, scratch_path

CAPTURE = "key string, file string, offset long, length long"
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:.")
#: Captures in a block of the index.
BLOCK = 512
#: Bytes of an archive that are read back by one task together, and bytes that a task reads in all.
STRETCH, TASK_BYTES = 4 << 20, 64 << 20


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then ')' and path with query; scheme, user, port 80 or 443 and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"!{url}"
    if not host:
        return f"!{url or ''}"
    tail = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + tail


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {-1 if page_id is None else page_id:020d}"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target_uri(url: str | None, page_id: int | None) -> str:
    """An absolute URI in ASCII: what a URI cannot hold is percent-encoded; without a scheme the page's id stands for it."""
    plain = quote((url or "").strip(), safe="%/:?#[]@!$&'()*+,;=~-._")
    return plain if SCHEME.match(plain) else f"urn:page:{'none' if page_id is None else page_id}"


def _record(head: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}:{offset}')}>"


def encode_info(file: str, date: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: quillgraph\r\nformat: WARC File Format 1.1\r\n"
    return _record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(file, 0), "WARC-Date": date, "WARC-Filename": file, "Content-Type": "application/warc-fields"}, block)


def encode_record(name: str, date: str, page_id, url, payload: bytes, refers_to=None, refers_url=None) -> bytes:
    """One record: a response, or a revisit without the payload if refers_to (a page id) is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name,
        "WARC-Date": date,
        "WARC-Target-URI": target_uri(url, page_id),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "Content-Type": "application/http;msgtype=response",
    }
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": target_uri(refers_url, refers_to), "WARC-Refers-To-Date": date, "X-Refers-To-Page-ID": str(refers_to)}
    return _record(head, http if refers_to is not None else http + payload)


def decode_record(raw: bytes) -> dict:
    """Header fields and payload of one record; a response's digest is checked against its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.decode().split("Content-Length: ")[1].split("\r\n")[0])
    if fields["WARC-Type"] == "response" and (len(payload) != size or f"sha1:{payload_digest(payload)}" != fields["WARC-Payload-Digest"]):
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    return fields | {"payload": payload, "payload_bytes": size}


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _archive_writer(folder: str, date: str):
    def run(batches):
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            ids, urls, payloads, refers, refers_urls = (batch.column(i) for i in range(5))
            rows = {"key": [], "file": [], "offset": [], "length": []}
            if out is None and batch.num_rows:
                out = store.open_output_stream(f"{root}/{name}", compression=None)
                info = gzip.compress(encode_info(name, date), 4, mtime=0)
                out.write(info)
                at = len(info)
            for page_id, url, payload, refers_to, refers_url in zip(ids.to_pylist(), urls.to_pylist(), payloads, refers.to_pylist(), refers_urls.to_pylist()):
                member = gzip.compress(encode_record(record_id(name, at), date, page_id, url, payload.as_buffer().to_pybytes(), refers_to, refers_url), 4, mtime=0)
                out.write(member)
                for k, v in zip(rows, (capture_key(url, page_id), name, at, len(member))):
                    rows[k].append(v)
                at += len(member)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out:
            out.close()

    return run


def _index_writer(folder: str):
    """Rows come in key order: compressed blocks, then their directory, then the directory's place."""

    def run(batches):
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        name, out, at, block, directory = f"{uuid.uuid4().hex}.cdx", None, 0, [], []

        def flush():
            nonlocal at, block
            if block:
                packed = zlib.compress(json.dumps(block).encode(), 6)
                directory.append([block[0][0], at, len(packed)])
                out.write(packed)
                at, block = at + len(packed), []

        for batch in batches:
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                block.append(row)
                if len(block) == BLOCK:
                    flush()
        if out is None:
            return
        flush()
        packed = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(packed)
        out.write(at.to_bytes(8, "big") + len(packed).to_bytes(8, "big"))
        out.close()
        yield pa.RecordBatch.from_pydict({"first_key": [directory[0][0]], "part": [name]}, schema=pa.schema([("first_key", pa.string()), ("part", pa.string())]))

    return run


class CaptureIndex:
    """Reader of the index files of one folder; parts are (first key, file name), sorted."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]):
        self.parts, (self.store, self.root) = parts, _open(folder)
        self.first = [p[0] for p in parts]
        self.directory = lru_cache(16)(self._directory)
        self.block = lru_cache(64)(self._block)

    def _directory(self, name: str):
        with self.store.open_input_file(f"{self.root}/{name}") as f:
            tail = f.read_at(16, f.size() - 16)
            rows = json.loads(zlib.decompress(f.read_at(int.from_bytes(tail[8:], "big"), int.from_bytes(tail[:8], "big"))))
        return [r[0] for r in rows], rows

    def _block(self, name: str, offset: int, length: int):
        with self.store.open_input_file(f"{self.root}/{name}") as f:
            rows = json.loads(zlib.decompress(f.read_at(length, offset)))
        return [r[0] for r in rows], rows

    def find(self, key: str) -> list:
        """Captures of a key. Equal keys may run over blocks and files; the first can start in the one before."""
        found = []
        p = max(0, bisect.bisect_left(self.first, key) - 1)
        while p < len(self.parts) and self.first[p] <= key:
            name = self.parts[p][1]
            firsts, blocks = self.directory(name)
            b = max(0, bisect.bisect_left(firsts, key) - 1)
            while b < len(blocks) and firsts[b] <= key:
                keys, rows = self.block(name, blocks[b][1], blocks[b][2])
                found += rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                b += 1
            p += 1
        return found


def _finder(folder: str, parts: list[tuple[str, str]]):
    def run(batches):
        index = CaptureIndex(folder, parts)
        for batch in batches:
            rows = [r for key in batch.column(0).to_pylist() for r in index.find(key)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"]
            )

    return run


def _record_reader(folder: str):
    def run(batches):
        store, root = _open(folder)
        name, f = None, None
        for batch in batches:
            out = {"page_id": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, store.open_input_file(f"{root}/{file}")
                record = decode_record(gzip.decompress(f.read_at(length, offset)))
                number = lambda field: int(record[field]) if field in record else None  # noqa: B023,E731
                for k, v in zip(out, (number("X-Page-ID"), record["payload_bytes"], record["WARC-Payload-Digest"][5:], record["WARC-Type"], number("X-Refers-To-Page-ID"))):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))
        if f:
            f.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_revisit: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per page into archives below folder; returns the captures (key, file, offset, length)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    top = rows.groupBy("sha", "size").agg(F.max("page_id").alias("top_id"), F.max_by("url", "page_id").alias("top_url"), F.count("*").alias("many")).where("many > 1")
    # A table of repeated payloads alone, written so that Spark knows its size: small, it goes to the payloads, which then stay where they are.
    repeated = materialize(top.where(F.col("size") >= least_revisit).select("sha", "size", "top_id", "top_url"), "repeated-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("top_id")), F.col("top_id")).alias("refers_to")
    joined = rows.join(repeated, ["sha", "size"], "left").select("page_id", "url", "payload", refers, "top_url")
    return materialize(joined.mapInArrow(_archive_writer(folder, date), CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Write the range-sorted index; returns each file's first key, a list as long as the ranges are many."""
    n = max(1, partitions(captures.sparkSession))
    parts = captures.repartitionByRange(n, "key", "file", "offset").sortWithinPartitions("key", "file", "offset").mapInArrow(_index_writer(folder), "first_key string, part string")
    return sorted((r["first_key"], r["part"]) for r in parts.collect())


def lookup(keys: DataFrame, folder: str, parts: list[tuple[str, str]]) -> DataFrame:
    """Captures of the given keys. Sorted keys keep a task to few files and blocks."""
    n = max(1, partitions(keys.sparkSession))
    return keys.select("key").distinct().repartitionByRange(n, "key").sortWithinPartitions("key").mapInArrow(_finder(folder, parts), CAPTURE)


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Range-read and decode the records at (file, offset, length). A task has the records of a few stretches of archives."""
    n = max(1, partitions(places.sparkSession), -(-(places.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    near = places.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return near.mapInArrow(_record_reader(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least_revisit: int = 0) -> DataFrame:
    """Write all pages as WARC, index them, look every capture up again and read it back."""
    spark = pages.sparkSession
    archives, index = scratch_path(spark, "warc"), scratch_path(spark, "cdx")
    captures = write_archives(pages, archives, least_revisit)
    parts = write_index(captures, index)
    return read_records(materialize(lookup(captures, index, parts), "found-captures"), archives)
