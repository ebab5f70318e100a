"""Benchmark decontamination by pigeonhole edit matching.

An item of length L may differ from a passage of a document by up to ``rate`` * L edits. It is split
into one piece more than that: with so few edits at least one piece is untouched. Exact hits of all
pieces are found in one walk over the text, and the surroundings of a hit are verified with Myers'
bit-parallel edit distance. Overlapping surroundings are verified once.

Items are a stated query set. Their automaton goes to every task, in blocks of ``BLOCK_CHARS``; a
larger set takes more passes over the documents instead of more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.05
BLOCK_CHARS = 8_000_000

_SCHEMA = "_key long, item_id long, errors int, match_start long, match_end long"


def normal(text: str) -> str:
    """Lower case, single blanks: what is compared."""
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(start, piece) of ``errors`` + 1 pieces whose lengths differ by one at most."""
    n, k = len(item), errors + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def best_match(item: str, masks: dict[str, int], text: str, errors: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole item anywhere in ``text``, if within ``errors``.

    Myers' algorithm: one column of the edit table as two bit vectors of differences.
    """
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        up = minus | (full & ~(d0 | plus))
        down = plus & d0
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(d0 | up))
        minus = up & d0
        if score <= errors and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


def masks_of(item: str) -> dict[str, int]:
    """Per character, the bits of its places in the item."""
    out: dict[str, int] = {}
    for i, ch in enumerate(item):
        out[ch] = out.get(ch, 0) | (1 << i)
    return out


def _search(items: list[tuple[int, str]], rate: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        found_in: dict[str, list[tuple[int, int]]] = {}
        bits = [masks_of(item) for _, item in items]
        errors = [int(rate * len(item)) for _, item in items]
        for n, (_, item) in enumerate(items):
            for start, piece in pieces(item, errors[n]):
                found_in.setdefault(piece, []).append((n, start))
        for piece, places in found_in.items():
            machine.add_word(piece, (len(piece), places))
        machine.make_automaton()
        for frame in frames:
            rows = []
            for key, raw in zip(frame["_key"].tolist(), frame["_text"].tolist(), strict=True):
                text = normal(raw) if isinstance(raw, str) else ""
                spans: dict[int, list[list[int]]] = {}
                for end, (size, places) in machine.iter(text):
                    for n, start in places:
                        at = end + 1 - size - start  # where the item would begin
                        a, b = max(0, at - errors[n]), at + len(items[n][1]) + errors[n]
                        known = spans.setdefault(n, [])
                        # one span for all hits of one passage; ends come in order, starts nearly so
                        if known and a <= known[-1][1] - len(items[n][1]):
                            known[-1][0], known[-1][1] = min(a, known[-1][0]), max(b, known[-1][1])
                        else:
                            known.append([a, b])
                for n, known in spans.items():
                    best = None
                    for a, b in known:
                        got = best_match(items[n][1], bits[n], text[a:b], errors[n])
                        if got and (best is None or got[0] < best[0]):
                            best = (got[0], a + got[1])
                    if best:
                        start = max(0, best[1] - len(items[n][1]))
                        rows.append((None if key != key else key, items[n][0], best[0], start, best[1]))
            if rows:
                out = pd.DataFrame(rows, columns=["_key", "item_id", "errors", "match_start", "match_end"])
                yield out.astype({"_key": "Int64"})

    return run


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, errors, match_start, match_end): the best match of an item in a document.

    One row per pair of row and item that match; offsets count characters of the normalised text
    (see ``normal``), the start is that of a match without insertions or deletions. Null, empty and
    blank texts and items match nothing. Rows and items that repeat match each. Columns beyond the
    key and the text are not looked at.
    """
    asked = items.select(F.col("item_id").cast("long"), F.col("text")).where("text is not null")
    blocks: list[list[tuple[int, str]]] = [[]]
    size = 0
    for item_id, raw in asked.orderBy("item_id", "text").toLocalIterator():
        item = normal(raw)
        if size and size + len(item) > BLOCK_CHARS:
            blocks.append([])
            size = 0
        if item:
            blocks[-1].append((item_id, item))
            size += len(item)
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    found = [rows.mapInPandas(_search(b, rate), _SCHEMA) for b in blocks if b]
    if not found:
        found = [rows.where("false").selectExpr("_key", "_key item_id", "0 errors", "_key match_start", "_key match_end")]
    return reduce(DataFrame.union, found).withColumnRenamed("_key", key)
