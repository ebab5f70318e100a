"""WARC archives with a two-level capture index.

Records are gzip members of their own, so a byte range reads one. The index has a line per capture,
sorted by reversed-host URL key, in compressed blocks; each index file ends with a sparse directory of
its blocks. A lookup searches the files' first keys, then a directory, then a block, each by binary
search, and reads one range of each file.

Tasks write files of fresh names into a folder all executors share. Only files named in the table that
Spark commits count, so lost or repeated attempts leave nothing but unnamed files.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import checkpoint, scratch_path

LEAST = 1000  # bytes of a payload that may be a revisit
LINES = 3000  # of an index block
READ_BYTES = 32 << 20  # of the archives that one task of a look-up reads
SMALL = 64 << 20  # bytes that may be broadcast
DIGEST_BYTES = 100  # of a payload that occurs twice
FILE_BYTES = 1 << 30  # an archive is closed beyond this
DATE = "1970-01-01T00:00:00Z"  # of records whose table has no time

_PAGES = "key string, page_id long, file string, at long, size long"
_FILES = "file string, first string, last string"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None, page_id: int | None) -> str:
    """Host in reverse, path and query, then the page: captures of a site are neighbours."""
    try:
        u = urlsplit(url or "")
        host, path = u.hostname or "", (u.path or "/") + (f"?{u.query}" if u.query else "")
    except ValueError:
        host, path = "", url or ""
    return f"{','.join(reversed(host.split('.')))}){quote(path, safe='/?&=%')} {'-' if page_id is None else f'{page_id:020d}'}"


def _folder(path: str):
    """(file system, path) of a folder named by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has the HTTP header alone."""
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to) of a record; a response's are worked out anew."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    said = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(said["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None
    page, refers = number(said["WARC-Record-ID"]), number(said.get("WARC-Refers-To"))
    if said["WARC-Type"] == "response":
        return page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return page, size, said["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", refers


def _write(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _folder(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, None, 0
        for frame in frames:
            rows = []
            for page, url, html, digest, refers in zip(*[frame[c] for c in ("page_id", "url", "html", "digest", "refers_to")], strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                page, refers = (None if x != x or x is None else int(x) for x in (page, refers))
                url = url if isinstance(url, str) else ""
                body = record(page, url, html.encode(), digest, refers)
                out.write(body)
                rows.append((url_key(url, page), page, name, at, len(body)))
                at += len(body)
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "at", "size"]).astype({"page_id": "Int64"})
        if out is not None:
            out.close()

    return run


def _index(folder: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _folder(folder)
        files.create_dir(root, recursive=True)
        out, name, at, directory, lines, first, last = None, f"{uuid.uuid4().hex}.idx", 0, [], [], None, None

        def close_block():
            nonlocal at, lines
            body = zlib.compress("\n".join(f"{k}\t{f}\t{o}\t{s}" for k, f, o, s in lines).encode(), 3)
            out.write(body)
            directory.append((lines[0][0], at, len(body)))
            at, lines = at + len(body), []

        for frame in frames:
            for row in zip(frame["key"], frame["file"], frame["at"], frame["size"], strict=True):
                if out is None:
                    out, first = files.open_output_stream(f"{root}/{name}", compression=None), row[0]
                lines.append(row)
                last = row[0]
                if len(lines) >= LINES:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            body = zlib.compress(json.dumps(directory).encode())
            out.write(body + len(body).to_bytes(8, "big"))
            out.close()
            yield pd.DataFrame([(name, first, last)], columns=["file", "first", "last"])

    return run


def _read(folder: str, index: list[tuple[str, str, str]]):
    firsts = [x[1] for x in index]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _folder(folder)
        handles: dict = {}
        directories: dict = {}
        blocks: dict = {}

        def handle(name):
            if name not in handles:
                while len(handles) >= 64:
                    handles.pop(next(iter(handles))).close()
                handles[name] = files.open_input_file(f"{root}/{name}")
            return handles[name]

        def directory(name):
            if name not in directories:
                if len(directories) >= 8:
                    directories.clear()
                f = handle(name)
                size = f.size()
                n = int.from_bytes(f.read_at(8, size - 8), "big")
                directories[name] = json.loads(zlib.decompress(f.read_at(n, size - 8 - n)))
            return directories[name]

        def block(name, at, size):
            if (name, at) not in blocks:
                if len(blocks) >= 4:
                    blocks.pop(next(iter(blocks)))
                rows = [x.split("\t") for x in zlib.decompress(handle(name).read_at(size, at)).decode().split("\n")]
                blocks[name, at] = [r[0] for r in rows], rows
            return blocks[name, at]

        def captures(key):
            # from the last file, block and line that begin before the key, on to the first beyond it
            for i in range(max(0, bisect.bisect_left(firsts, key) - 1), len(index)):
                if firsts[i] > key:
                    return
                if index[i][2] < key:
                    continue
                known = directory(index[i][0])
                starts = [d[0] for d in known]
                for b in range(max(0, bisect.bisect_left(starts, key) - 1), len(known)):
                    if starts[b] > key:
                        break
                    keys, rows = block(index[i][0], known[b][1], known[b][2])
                    for at in range(bisect.bisect_left(keys, key), len(keys)):
                        if keys[at] != key:
                            break
                        yield rows[at]

        for frame in frames:
            found = [parse(handle(f).read_at(int(size), int(at))) for key in frame["key"] for _, f, at, size in captures(key)]
            if found:
                out = pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        for f in handles.values():
            f.close()

    return run


class Archive:
    """Archives and index of a table of pages (page_id, url, html) in a shared folder."""

    def __init__(self, pages: DataFrame, folder: str | None = None) -> None:
        """Writes both.

        Of rows with equal payloads of LEAST bytes or more that with the largest page_id is the
        response, the others revisit it; rows that repeat that page_id, and all with a null one, are
        responses too. A null html is an empty payload, a null url an empty one. An empty table gives
        an archive without files.
        """
        spark = pages.sparkSession
        self.folder = folder or scratch_path(spark, "warc")
        html = F.coalesce("html", F.lit(""))
        p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
        p = p.withColumn("digest", F.sha1(F.col("html").cast("binary")))
        # only payloads that occur twice have anything to refer to
        last = p.where(F.octet_length("html") >= LEAST).groupBy(F.col("digest").alias("of")).agg(
            F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")
        )
        last = checkpoint(last.where("n > 1").select("of", "last"))
        if last.count() * DIGEST_BYTES <= SMALL:
            last = F.broadcast(last)  # pages stay where they are
        p = p.join(last, F.col("digest") == F.col("of"), "left")
        refers = F.when(F.col("page_id") < F.col("last"), F.col("last"))
        written = p.select("page_id", "url", "html", "digest", refers.alias("refers_to")).mapInPandas(_write(self.folder), _PAGES)
        self.captures = checkpoint(written)
        ordered = self.captures.repartitionByRange("key").sortWithinPartitions("key")
        made = checkpoint(ordered.mapInPandas(_index(self.folder), _FILES))
        size = self.captures.agg(F.sum("size")).first()[0] or 0
        self.parts = max(spark.sparkContext.defaultParallelism, -(-size // READ_BYTES))
        # one row per partition of the index
        self.index = [tuple(r) for r in made.orderBy("first", "last").collect()]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Records of the captures whose ``key`` (see ``url_key``) is among ``keys``, repeats once."""
        near = keys.select("key").where("key is not null").distinct()
        # the bytes to read, not those of the keys, tell how many tasks there are
        near = near.repartitionByRange(self.parts, "key").sortWithinPartitions("key")
        return near.mapInPandas(_read(self.folder, self.index), _RECORDS)
