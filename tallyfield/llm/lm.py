"""Language-model scores by backoff with Dirichlet smoothing.

The model is that of a weighted backoff automaton: states are the n-grams of the training texts, with
an arc for every word seen after them and a failure arc to the state without the first word.
Smoothing takes the shorter state's distribution as a Dirichlet prior of ``prior`` words, so all
weights follow from plain counts:

    arc      log10((c(h, w) + prior * p(w | h')) / (c(h) + prior))
    failure  log10(prior / (c(h) + prior))

The root is the word distribution with half a count for every word and for one unseen word.

No automaton is built or walked. The state before a word is known from the text alone (the n-gram
that ends there), so the recursion is evaluated level by level, at all places of a bundle at once, on
arrays of counts: equal scores, without a step of Python per word. Each bundle of documents asks for
the counts of its own n-grams (see ``packed``), so the whole model need not fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.packed import bundles, ids, pack, ranges, unpack
from tallyfield.session import checkpoint

ORDER = 2
PRIOR = 500.0  # words; texts of this kind repeat few pairs, so a pair must be seen often to count
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)  # of a text

_COLUMNS = ["bundle", "level", "part", "ids", "held", "lengths", "a", "b"]
_TABLE = "bundle long, level int, part int, ids array<long>, held binary, lengths binary, a binary, b binary"


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes, order included."""
    out = np.empty(len(b), np.uint64)
    for i in range(0, len(b), 1 << 20):  # in parts, so that steps between take little memory
        x, y = a[i : i + (1 << 20)], b[i : i + (1 << 20)]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + y
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        out[i : i + (1 << 20)] = x ^ (x >> np.uint64(31))
    return out


def _grams(words: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per level, the hash of the n-gram that ends at each place; texts begin with START."""
    out, before = [words], words
    for level in range(1, order):
        lead = START
        for _ in range(level - 1):
            lead = _mix(np.array([lead]), np.array([START]))[0]
        shifted = np.empty_like(words)
        shifted[1:] = before[:-1]
        # a start in the middle of an n-gram: all of what lies before it counts as START
        shifted[starts] = lead
        # 56 bits tell n-grams apart: a chance match among 10^12 of them is one in 10^4; words keep 64
        before = _mix(shifted, words) & ~np.uint64(0xFF)
        out.append(before)
    return out


def _stream(numbers: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each with its END, and where texts start."""
    return np.append(hashes, END)[numbers], np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def _encode(order: int, parts: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for bundle, (keys, held, texts) in bundles(frames, ["_key", "_held", "_text"]):
            seen = _Numbers()
            streams = []
            for text in texts:
                # lower() and split() of bytes know ASCII alone: A-Z, and the six white characters
                streams.append(np.array([seen[w] for w in text.encode().lower().split()] + [-1], np.int32))
            texts.clear()
            lengths = np.array([len(s) for s in streams], np.uint32)
            numbers = np.concatenate(streams)
            streams.clear()
            numbers[numbers < 0] = len(seen)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in seen), np.uint64, len(seen))
            # frequent words get small numbers, which take few bytes
            often = np.argsort(-np.bincount(numbers, minlength=len(seen) + 1)[:-1], kind="stable")
            rank = np.empty(len(seen) + 1, np.int32)
            rank[often], rank[-1] = np.arange(len(seen), dtype=np.int32), len(seen)
            numbers, hashes = rank[numbers], hashes[often]
            seen.clear()
            learned = np.repeat(~np.array(held, bool), lengths)
            rows = [(bundle, 0, -1, ids(keys), pack(np.array(held, np.uint8)), pack(lengths), pack(numbers.astype(np.uint32)), pack(hashes))]
            words, starts = _stream(numbers, hashes, lengths)
            for level, grams in enumerate(_grams(words, starts, order), 1):
                if level == 1:  # words are told apart already
                    counts = np.bincount(numbers[learned], minlength=len(hashes) + 1).astype(np.uint32)
                    distinct = np.append(hashes, END)
                    by_hash = np.argsort(distinct)
                    distinct, counts = distinct[by_hash], counts[by_hash]
                else:  # the free low bit holds whether the place counts, so that one sort in place does
                    marked = grams | learned
                    marked.sort()
                    distinct = marked & ~np.uint64(0xFF)
                    first = np.flatnonzero(np.concatenate(([True], distinct[1:] != distinct[:-1])))
                    distinct = distinct[first]
                    marked &= np.uint64(1)
                    counts = np.add.reduceat(marked, first).astype(np.uint32)
                    del marked, first
                part = ranges(distinct, parts)
                cuts = np.searchsorted(part, np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cuts)):
                    s = slice(cuts[p], cuts[p + 1])
                    gaps = np.diff(distinct[s], prepend=np.uint64(0))
                    rows.append((bundle, level, int(p), None, None, None, pack(gaps), pack(counts[s])))
            for at in range(0, len(rows), 64):
                yield pd.DataFrame(rows[at : at + 64], columns=_COLUMNS)

    return run


def _merge(blocks: pd.DataFrame) -> pd.DataFrame:
    """Adds the counts of one hash range up and answers every bundle in its own order; texts pass.

    Bundle -1 gets the sum of the range's counts and the number of its n-grams seen in training.
    """
    blocks = blocks[_COLUMNS]
    if blocks["level"].iloc[0] == 0:
        return blocks.assign(n=0, v=0)
    level, part = int(blocks["level"].iloc[0]), int(blocks["part"].iloc[0])
    grams = [np.cumsum(unpack(x)) for x in blocks["a"]]
    counts = [unpack(x) for x in blocks["b"]]
    distinct, where = np.unique(np.concatenate(grams), return_inverse=True)
    totals = np.bincount(where, weights=np.concatenate(counts)).astype(np.uint64)
    rows, at = [], 0
    for bundle, g in zip(blocks["bundle"], grams, strict=True):
        rows.append((bundle, level, part, None, None, None, pack(totals[where[at : at + len(g)]]), None, 0, 0))
        at += len(g)
    rows.append((-1, level, part, None, None, None, None, None, int(totals.sum()), int((totals > 0).sum())))
    return pd.DataFrame(rows, columns=[*_COLUMNS, "n", "v"])


def _walk(order: int, prior: float, n: int, v: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        text = rows[rows["level"] == 0].iloc[0]
        numbers, hashes, lengths = unpack(text["a"]).astype(np.int64), unpack(text["b"]), unpack(text["lengths"])
        words, starts = _stream(numbers, hashes, lengths)
        ends = np.cumsum(lengths.astype(np.int64)) - 1
        rows = rows.sort_values(["level", "part"])
        p, base, known, shorter = None, None, None, None
        for level, grams in enumerate(_grams(words, starts, order), 1):
            # parts are ranges of the hash: one after the other they are in the order of unique()
            totals = np.concatenate([unpack(x) for x in rows.loc[rows["level"] == level, "a"]])
            distinct, where = np.unique(grams, return_inverse=True)
            if len(distinct) != len(totals):
                raise RuntimeError("a bundle changed between two reads: give rows of a written table")
            seen = totals[where].astype(np.float64)
            del distinct, where, totals
            if level == 1:
                p = (seen + 0.5) / (n + 0.5 * (v + 1))
                base, known, texts = np.log10(p), seen > 0, seen[ends[0]]
            else:
                state = np.empty_like(seen)  # how often the state before this word was entered
                state[1:] = shorter[:-1]
                state[starts] = texts
                # an arc where the n-gram was seen, else the failure arc and the shorter state's arc
                p = np.where(seen > 0, (seen + prior * p) / (state + prior), prior / (state + prior) * p)
            shorter = seen
        return pd.DataFrame(
            {
                "_key": pd.array(ids(text["ids"]), dtype="Int64"),
                "held_out": unpack(text["held"]).astype(bool),
                "n_tokens": lengths.astype(np.int64),
                "n_known": np.add.reduceat(known.astype(np.int64), starts),
                "train_tokens": np.full(len(lengths), n, np.int64),
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(np.log10(p), starts),
            }
        )

    return run


def scored(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", order: int = ORDER,
    prior: float = PRIOR, parts: int | None = None,
) -> DataFrame:
    """Scores of every row by a model of the rows that are not held out.

    Columns: key, held_out, n_tokens (words and one end), n_known (seen in training), train_tokens,
    base_score (root alone) and score, both log10 probabilities of the whole text. Null and empty
    texts have the end alone. Rows that repeat are scored, and learned from, each. An empty table,
    or one without training rows, still has the root's unseen word. The key is an integer or null.
    ``parts`` is the number of hash ranges, by default that of shuffle partitions. Rows should be those
    of a written table: after a lost executor it is read again, and a bundle that then comes out
    otherwise is an error.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(key).cast("long").alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"), F.col(text).alias("_text")
    )
    # one shuffle for texts and blocks alike: each text row is a group of its own and passes
    table = rows.mapInPandas(_encode(order, parts), _TABLE).withColumn("own", F.when(F.col("level") == 0, F.col("bundle")))
    merged = checkpoint(
        table.groupBy("level", "part", "own").applyInPandas(_merge, f"{_TABLE}, n long, v long")
    )
    sums = merged.where("bundle = -1 and level = 1").agg(F.sum("n"), F.sum("v")).first()
    n, v = sums[0] or 0, sums[1] or 0
    parted = merged.where("bundle >= 0").drop("n", "v")
    schema = "_key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = parted.groupBy("bundle").applyInPandas(_walk(order, prior, n, v), schema)
    return out.withColumnRenamed("_key", key)
