"""Bundles of documents with a dictionary of their own, and number arrays as compact bytes.

Two operators look up corpus-wide counts for every word of every document. A row for each
(document, word) would move several times the corpus. Instead a task bundles documents, finds the
distinct keys of a bundle once, and sends them in one block per range of the key hash. The task that
owns a range merges the blocks of all bundles and answers each with values in the order it asked.
A hot key is one entry per bundle, so no range is larger than others by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

BUNDLE_CHARS = 12_000_000  # texts of one bundle; one longer text is a bundle of its own


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes: planes of equal significance, compressed; order is kept."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    head = f"{values.dtype.str},{len(values)};".encode()
    return head + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """The array of :func:`pack`."""
    head, _, body = bytes(data).partition(b";")
    kind, _, n = head.decode().partition(",")
    dtype, count = np.dtype(kind), int(n)
    raw = pa.decompress(body, decompressed_size=count * dtype.itemsize, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, count)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def bundles(frames: Iterable, columns: list[str], limit: int = BUNDLE_CHARS) -> Iterator[tuple[int, list[list]]]:
    """(bundle number, columns as lists) from batches; the last of ``columns`` is the text.

    Numbers hold the partition, so they are unique in a written table. Null texts become empty.
    """
    part = TaskContext.get().partitionId()
    number, held, size = 0, [[] for _ in columns], 0
    for frame in frames:
        lists = [frame[c].tolist() for c in columns]
        for row in zip(*lists, strict=True):
            text = row[-1] if isinstance(row[-1], str) else ""
            for to, x in zip(held, (*row[:-1], text), strict=True):
                to.append(x)
            size += len(text) + 1
            if size >= limit:
                yield (part << 32) | number, held
                number, held, size = number + 1, [[] for _ in columns], 0
    if held[0]:
        yield (part << 32) | number, held


def ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` equal ranges each 64-bit hash is in; grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def ids(values: Iterable) -> list[int | None]:
    """Integer ids as Python values, null as None."""
    return [None if v is None or v != v else int(v) for v in values]


def pack_texts(texts: list[str]) -> bytes:
    """Strings as bytes: their lengths, then all of them."""
    raw = [t.encode() for t in texts]
    sizes, body = pack(np.array([len(r) for r in raw], np.uint32)), b"".join(raw)
    return f"{len(sizes)},{len(body)};".encode() + sizes + pa.compress(body, codec="zstd", asbytes=True)


def unpack_texts(data: bytes) -> list[str]:
    """The strings of :func:`pack_texts`."""
    head, _, rest = bytes(data).partition(b";")
    n, size = map(int, head.split(b","))
    body = pa.decompress(rest[n:], decompressed_size=size, codec="zstd", asbytes=True)
    ends = np.cumsum(unpack(rest[:n]).astype(np.int64)).tolist()
    return [body[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []
