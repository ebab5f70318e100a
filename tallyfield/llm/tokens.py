"""Token counts: pieces per distinct pre-token, joined to the pre-token frequencies of documents.

A byte-level BPE never merges across pre-tokens, so the tokens of a text are the sum over its
pre-tokens. The corpus has few distinct ones: each is encoded once, in the range of its hash, and
documents only keep how often they have which. Token ids of texts are never built.

Frequencies of a bundle of documents are kept as numbers into the bundle's own dictionary, and the
dictionary is sent by ranges of the hash (see ``packed``): a row per document and pre-token would
move more than the corpus.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.packed import bundles, ids, pack, pack_texts, ranges, unpack, unpack_texts
from tallyfield.session import checkpoint

# Fixed value: the pre-token pattern of the byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts of these characters alone are split by PATTERN here; others by the library itself, whose
# tables of letters and spaces may be of another Unicode version.
PLAIN = r"[\t\n\r\x20-\x7E¡-ɏ‐-‟…]*"
ONCE = 2_000  # pre-tokens given to the library at a time
BUNDLE_CHARS = 20_000_000  # texts of one bundle; larger ones repeat fewer pre-tokens

_TABLE = "bundle long, part int, ids array<long>, bytes binary, extra binary, sizes binary, a binary, b binary, pieces binary"
_ANSWER = "bundle long, part int, a binary, b binary"


class _Numbers(dict):
    """Numbers pre-tokens in order of appearance."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


def _library(path: str):
    """The tokenizer of a file, and the added strings that it looks for in texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    split = said.get("pre_tokenizer") or {}
    if said.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level files without a normalizer or a prefix space have the pre-tokens counted here")
    added = said.get("added_tokens") or []
    if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return made, [a["content"] for a in added]


def _splitter(made, added: list[str]):
    """text -> (pre-tokens, occurrences of added strings)."""
    find, plain = regex.compile(PATTERN).findall, regex.compile(PLAIN).fullmatch
    cut = regex.compile("|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True))) if added else None

    def pre(text: str) -> list[str]:
        if plain(text):
            return find(text)
        return [text[a:b] for _, (a, b) in made.pre_tokenizer.pre_tokenize_str(text)]

    def split(text: str) -> tuple[list[str], int]:
        if cut is None or not cut.search(text):
            return pre(text), 0
        pieces, last, n = [], 0, 0
        for m in cut.finditer(text):
            if m.start() > last:
                pieces += pre(text[last : m.start()])
            last, n = m.end(), n + 1
        return pieces + (pre(text[last:]) if last < len(text) else []), n

    return split


def _encode(path: str, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split = _splitter(*_library(path))
        for bundle, (keys, texts) in bundles(frames, ["_key", "_text"], BUNDLE_CHARS):
            seen = _Numbers()
            which, often, sizes = [], [], np.zeros(len(texts), np.uint32)
            extra, n_bytes = np.zeros(len(texts), np.uint32), np.zeros(len(texts), np.uint64)
            for i, text in enumerate(texts):
                pieces, extra[i] = split(text)
                n_bytes[i] = len(text.encode())
                got, n = np.unique(np.array([seen[p] for p in pieces], np.int64), return_counts=True)
                which.append(np.diff(got, prepend=0))
                often.append(n)
                sizes[i] = len(got)
            first = (bundle, -1, ids(keys), pack(n_bytes), pack(extra), pack(sizes), pack(np.concatenate(which).astype(np.uint32)), pack(np.concatenate(often).astype(np.uint32)), None)
            distinct = np.array(list(seen), object)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in seen), np.uint64, len(seen))
            part = ranges(hashes, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [first]
            for p in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[p] : cuts[p + 1]]
                rows.append((bundle, int(p), None, None, None, None, pack(at.astype(np.uint32)), None, pack_texts(distinct[at].tolist())))
            columns = ["bundle", "part", "ids", "bytes", "extra", "sizes", "a", "b", "pieces"]
            for i in range(0, len(rows), 64):
                yield pd.DataFrame(rows[i : i + 64], columns=columns)

    return run


def _count(path: str):
    def run(blocks: pd.DataFrame) -> pd.DataFrame:
        """Pieces of the pre-tokens of one hash range, each encoded once, for every bundle."""
        made, _ = _library(path)
        made.encode_special_tokens = True  # what is left of them was split, so it is ordinary text
        asked = [unpack_texts(x) for x in blocks["pieces"]]
        distinct = list({p for pieces in asked for p in pieces})
        n: dict[str, int] = {}
        for i in range(0, len(distinct), ONCE):
            some = distinct[i : i + ONCE]
            n.update(zip(some, (len(e.ids) for e in made.encode_batch(some, add_special_tokens=False)), strict=True))
        counts = [pack(np.array([n[p] for p in pieces], np.uint32)) for pieces in asked]
        return pd.DataFrame({"bundle": blocks["bundle"], "part": blocks["part"], "a": blocks["a"], "b": counts})

    return run


def _sum(rows: pd.DataFrame) -> pd.DataFrame:
    """Tokens of every document of a bundle."""
    docs = rows[rows["part"] == -1].iloc[0]
    answers = rows[rows["part"] >= 0]
    pieces = np.zeros(0, np.int64)
    if len(answers):
        at = np.concatenate([unpack(x) for x in answers["a"]])
        pieces = np.zeros(len(at), np.int64)
        pieces[at] = np.concatenate([unpack(x) for x in answers["b"]])
    sizes = unpack(docs["sizes"]).astype(np.int64)
    gaps, often = unpack(docs["a"]).astype(np.int64), unpack(docs["b"]).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    # numbers restart with each document
    upto = np.concatenate(([0], np.cumsum(gaps)))
    which = upto[1:] - np.repeat(upto[starts[:-1]], sizes)
    total = np.concatenate(([0], np.cumsum(pieces[which] * often)))
    return pd.DataFrame(
        {
            "_key": pd.array(ids(docs["ids"]), dtype="Int64"),
            "n_bytes": unpack(docs["bytes"]).astype(np.int64),
            "n_tokens": total[starts[1:]] - total[starts[:-1]] + unpack(docs["extra"]).astype(np.int64),
        }
    )


def counted(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens) of every row, as the library counts the whole text.

    Null and empty texts have no token. Strings of added tokens inside a text are one token each,
    the library's default. Rows that repeat are counted each; the key is an integer or null. An empty
    table gives an empty result. ``path`` is a file that every executor has.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    table = checkpoint(rows.mapInPandas(_encode(path, parts), _TABLE))
    blocks = table.where("part >= 0").select("bundle", "part", "a", "pieces")
    answers = blocks.groupBy("part").applyInPandas(_count(path), _ANSWER)
    parted = table.where("part = -1").drop("pieces").unionByName(answers, allowMissingColumns=True)
    out = parted.groupBy("bundle").applyInPandas(_sum, "_key long, n_bytes long, n_tokens long")
    return out.withColumnRenamed("_key", key)
