"""Join of texts whose word n-gram sets have a Jaccard similarity of a threshold or more.

MinHash banding: a text gets ``bands`` * ``rows`` minima of its n-gram set under different hash
functions. Texts that agree in all rows of a band share a bucket; at similarity s a pair shares one
with probability 1 - (1 - s^rows)^bands, 0.9993 at 0.8 for 24 bands of 6. Buckets are found by a
shuffle on band hashes, and pairs are verified on full n-gram sets.

Equal n-gram sets are one class from the start, and one text of each is verified. Texts that hang
together by buckets are packed into blocks of bounded size, those of a bucket next to each other, and
two blocks are compared where a bucket has texts in both. So a chain of buckets costs a chain of
block pairs, only a bucket's own texts are all compared, and no task holds more than two blocks. What
leaves a block is a count per text and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.llm.components import components
from tallyfield.operators.ordered import Ordered, row_number, running_sum
from tallyfield.session import checkpoint, scratch_path

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 6
BLOCK_TEXTS = 256  # texts of one block
BLOCK_GRAMS = 400_000  # n-grams of one block, beside the one text that fills it
LANES = 1 << 16  # hash values worked on at a time

_SKETCH = "row long, key long, grams int, same string, bands array<long>"


class _Hashes(dict):
    """64-bit hash of each word, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 2_000_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def gram_set(text: str, n: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; texts of fewer words have one, of all words."""
    cut = text.encode().split()
    words = np.fromiter(map(known.__getitem__, cut), np.uint64, len(cut))
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + words[i : len(words) - size + 1 + i]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ (h >> np.uint64(31)))


def minima(grams: np.ndarray, times: np.ndarray, plus: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Smallest value of times * g + plus over all n-grams g, for each pair of ``times`` and ``plus``.

    Values have 32 bits, mixed from both halves of an n-gram's hash; ``room`` is working memory.
    """
    low = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    g = (grams ^ (grams >> np.uint64(32))).astype(np.uint32)
    width = room.shape[1]
    for at in range(0, len(g), width):
        part = g[at : at + width]
        lanes = room[:, : len(part)]
        np.multiply(times[:, None], part, out=lanes)
        lanes += plus[:, None]
        np.minimum(low, lanes.min(axis=1), out=low)
    return low


def _sketch(n: int, bands: int, rows: int, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = np.random.default_rng(seed)
        times = draw.integers(0, 1 << 31, bands * rows, np.uint32) * np.uint32(2) + np.uint32(1)
        plus = draw.integers(0, 1 << 32, bands * rows, np.uint32)
        room = np.empty((bands * rows, max(1, LANES // (bands * rows))), np.uint32)
        known = _Hashes()
        for frame in frames:
            out = []
            for row, text in zip(frame["row"].tolist(), frame["text"].tolist(), strict=True):
                grams = gram_set(text, n, known) if isinstance(text, str) else np.zeros(0, np.uint64)
                if not len(grams):
                    out.append((row, 0, None, None))
                    continue
                mixed = minima(grams, times, plus, room).reshape(bands, rows)
                keys = [xxhash.xxh3_64_intdigest(mixed[b].tobytes(), b) for b in range(bands)]
                same = f"{len(grams):x}-{xxhash.xxh3_128_hexdigest(grams.tobytes())}"
                out.append((row, len(grams), same, np.array(keys, np.uint64).view(np.int64)))
            done = pd.DataFrame(out, columns=["row", "grams", "same", "bands"])
            done["key"] = frame["key"].to_numpy()  # as it came, null included
            yield done

    return run


def _verify(n: int, threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = _Hashes()
        ids = group["id"].to_numpy(np.int64)
        copies = group["copies"].to_numpy(np.int64)
        sets = [gram_set(t, n, known) for t in group["text"]]
        sizes = np.array([len(s) for s in sets], np.int64)
        grams, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = np.bincount(where, minlength=len(grams)) > 1
        column = np.cumsum(shared) - 1
        use = shared[where]
        owner, column = owner[use], column[where[use]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        width = 8192
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [at, at + width])
            part = np.zeros((len(sets), width), np.float32)
            part[owner[a:b], column[a:b] - at] = 1
            common += part @ part.T
        linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-6
        np.fill_diagonal(linked, False)
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        if i != j:  # pairs within a block are counted where the block meets itself
            block = group["block"].to_numpy()
            linked &= block[:, None] != block[None, :]
        counts = linked.astype(np.int64) @ copies
        # a spanning forest of the links: breadth first from the smallest id
        todo, edges = set(range(len(ids))), []
        for root in np.argsort(ids):
            if root not in todo:
                continue
            todo.discard(int(root))
            front = [int(root)]
            while front and todo:
                rest = np.fromiter(todo, np.int64)
                new = rest[linked[np.ix_(front, rest)].any(axis=0)].tolist()
                edges += [(int(ids[x]), int(ids[root])) for x in new]
                todo.difference_update(new)
                front = new
        out = pd.DataFrame({"id": ids, "links": counts, "to": ids})
        return pd.concat([out, pd.DataFrame([(a, 0, b) for a, b in edges], columns=["id", "links", "to"])]).astype("int64")

    return run


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, text) of ``docs``, written: every read, also one after a lost executor, sees the same numbers."""
    path = scratch_path(docs.sparkSession, "texts")
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    named.write.parquet(path, compression="zstd")
    return docs.sparkSession.read.parquet(path)


def joined(
    docs: DataFrame, n: int = WORDS, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
    key: str = "doc_id", text: str = "text", seed: int = 7, written: bool = False,
) -> DataFrame:
    """(key, class_id, copy_id, n_links) of every row.

    Words are cut at white space and compared as they are. ``copy_id`` is the smallest key among
    rows of an equal n-gram set, ``n_links`` the number of other rows with a similarity of
    ``threshold`` or more, equal ones included, and ``class_id`` the smallest key of all rows that
    hang together by links. Texts of fewer than n words have one n-gram, of all words. Null and blank
    texts have none: they link to nothing and are classes of their own. Rows with a null key are
    joined like others; a class in which no row has a key has a null name. Rows that repeat a key
    count as rows, each by its own text. Other columns are not looked at. ``written`` says that
    ``docs`` is a stored table with a key of its own in every row, which then needs no numbers.
    """
    stored = docs.select(F.col(key).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    base = stored if written else numbered(docs, key, text)
    sketch = base.select("row", "key", "text").mapInPandas(_sketch(n, bands, rows, seed), _SKETCH)
    sketch = checkpoint(sketch)
    full = sketch.where("grams > 0")
    # classes of equal sets, known by their first row: equal rows are combined before the shuffle
    same = checkpoint(
        full.groupBy("same").agg(
            F.min("row").alias("id"), F.min("key").alias("copy"), F.count(F.lit(1)).alias("copies"),
            F.first("grams").alias("grams"), F.first("bands").alias("bands"),
        )
    )
    buckets = same.select("id", F.posexplode("bands").alias("band", "h"))
    heads = buckets.groupBy("band", "h").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a bucket is named by band and head, which only it has
    shared = checkpoint(buckets.join(heads.drop("n"), ["band", "h"]).select("id", "band", "head"))
    groups = components(shared.where("id <> head"), "id", "head").withColumnRenamed("node", "id")
    near = shared.groupBy("id").agg(F.min("head").alias("low"))
    members = groups.join(same.select("id", "copies", "grams"), "id").join(near, "id")
    packed = Ordered(members, ["root"], ["low", "id"]).add(upto=running_sum(F.col("grams")), nth=row_number()).result()
    block = F.floor((F.col("upto") - F.col("grams")) / BLOCK_GRAMS) + F.floor((F.col("nth") - 1) / BLOCK_TEXTS)
    members = checkpoint(packed.select("root", "id", "copies", block.cast("long").alias("block")))
    # blocks that a bucket has texts in
    spread = shared.join(members.select("id", "root", "block"), "id").select("root", "band", "head", "block").distinct()
    other = spread.select("band", "head", F.col("block").alias("j"))
    meets = spread.withColumnRenamed("block", "i").join(other, ["band", "head"]).where("i <= j").select("root", "i", "j").distinct()
    meets = checkpoint(meets)
    texts = checkpoint(members.join(base.select(F.col("row").alias("id"), "text"), "id"))
    left = texts.join(meets.withColumn("block", F.col("i")), ["root", "block"])
    right = texts.join(meets.where("i <> j").withColumn("block", F.col("j")), ["root", "block"])
    cols = ["root", "i", "j", "id", "copies", "block", "text"]
    asked = left.select(cols).union(right.select(cols))
    found = checkpoint(
        asked.groupBy("root", "i", "j").applyInPandas(_verify(n, threshold), "id long, links long, to long")
    )
    counts = found.where("id = to").groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(found.where("id <> to"), "id", "to").withColumnRenamed("node", "id")
    classes = same.select("same", "id", "copies", "copy").join(counts, "id", "left").join(linked, "id", "left")
    # a class is named by its smallest key, not by its smallest row
    names = classes.where("root is not null").groupBy("root").agg(F.min("copy").alias("class"))
    classes = classes.join(names, "root", "left")
    out = sketch.select("row", "key", "same").join(classes, "same", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("key").alias(key),
        F.coalesce("class", "copy", "key").alias("class_id"),
        F.coalesce("copy", "key").alias("copy_id"),
        (F.coalesce("links", zero) + F.coalesce(F.col("copies") - 1, zero)).alias("n_links"),
    )
