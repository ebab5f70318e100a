"""Language identification by the nearest of several centroids per language.

A text is a vector of its letter 1- to 3-grams (bytes of the lower-case text, everything that is no
letter as one blank), hashed to a fixed number of places, weighted by TF-IDF and scaled to length 1.
Document frequencies are counted over all training texts. Centroids come from spherical k-means within
each language, on a bounded sample: the texts of lowest hash, each distinct text once. A text goes to
the centroid of highest cosine; farther from it than nearly all training texts of that language are
from theirs, it is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.session import checkpoint

PLACES = 1 << 13  # of a vector
CENTROIDS = 4  # per language
SAMPLE = 400  # texts per language that k-means sees
REJECT_BELOW = 0.001  # share of training texts that may lie farther out
BATCH = 256
UNKNOWN = "und"
MAX_MODEL = 256 << 20  # bytes of all centroids that may be sent to every task
MAX_LANGS = 100_000  # rows of a table by language that may be broadcast

# 1 for bytes of letters: ASCII letters, and all bytes of other characters
_LETTER = np.array([1 if chr(b).isalpha() or b >= 128 else 0 for b in range(256)], np.uint8)
_SCHEMA = "_key long, held_out boolean, lang_pred string, score double, rejected boolean"


def profile(text: str) -> np.ndarray:
    """How often each place is hit; zeros for a text without letters."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    is_letter = _LETTER[raw] > 0
    raw = np.where(is_letter, raw, np.uint8(32)).astype(np.uint32)
    # runs of other characters count as one blank
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    b = np.concatenate((np.array([32], np.uint32), raw[keep], np.array([32], np.uint32)))
    one, two = b, b[:-1] | (b[1:] << np.uint32(8))
    three = two[:-1] | (b[2:] << np.uint32(16)) if len(b) > 2 else np.zeros(0, np.uint32)
    codes = np.concatenate((one, two | np.uint32(1 << 24), three | np.uint32(1 << 25)))
    at = (codes * np.uint32(2654435761)) >> np.uint32(32 - (PLACES.bit_length() - 1))
    return np.bincount(at, minlength=PLACES).astype(np.float32)


def has_letter(text: object) -> bool:
    """True if any character is a letter of any script."""
    return isinstance(text, str) and any(c.isalpha() for c in text)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows."""
    m = np.stack([profile(t) for t in texts])
    m = np.log1p(m) * idf
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    df, n = np.zeros(PLACES, np.int64), 0
    for frame in frames:
        for text in frame["_text"]:
            df += profile(text) > 0
            n += 1
    yield pd.DataFrame({"place": np.arange(-1, PLACES), "n": np.concatenate(([n], df))})


def _fit(idf: np.ndarray, k: int, sample: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h").head(sample)
        x = vectors(rows["_text"].tolist(), idf)
        # starts far from each other, the first next to the mean
        chosen = [int(np.argmax(x @ x.mean(axis=0)))]
        while len(chosen) < min(k, len(x)):
            chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
        c = x[chosen].copy()
        for _ in range(20):
            near = (x @ c.T).argmax(axis=1)
            new = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.allclose(new, c, atol=1e-6):
                break
            c = new
        lowest = float(np.quantile((x @ c.T).max(axis=1), REJECT_BELOW))
        lang = rows["_lang"].iloc[0]
        return pd.DataFrame({"lang": [lang] * len(c), "lowest": [lowest] * len(c), "centre": [v.astype(np.float32).tobytes() for v in c]})

    return run


def _predict(model, idf: np.ndarray):
    langs, lowest, centres = model

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["_text"].tolist()
            known = np.array([has_letter(t) for t in texts], bool) & bool(len(langs))
            pred, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(known)
            for i in range(0, len(at), BATCH):
                some = at[i : i + BATCH]
                close = vectors([texts[j] for j in some], idf) @ centres.T
                best = close.argmax(axis=1)
                score[some] = np.clip(close[np.arange(len(some)), best], 0.0, 1.0)
                far[some] = score[some] < lowest[best]
                for j, b in zip(some, best, strict=True):
                    pred[j] = langs[b]
            yield pd.DataFrame(
                {"_key": frame["_key"].astype("Int64"), "held_out": frame["_held"], "lang_pred": pred, "score": score, "rejected": far}
            )

    return run


def identified(
    docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
    k: int = CENTROIDS, sample: int = SAMPLE,
) -> DataFrame:
    """(key, held_out, lang_pred, score, rejected) of every row, learned from rows not held out.

    ``score`` is the cosine to the nearest centroid. Null texts and texts without a letter are
    ``und`` with score 0 and rejected; so are all where there is nothing to learn from. A rejected
    text keeps its nearest language. Ties go to the language first in order. Whole texts are read;
    rows that repeat are answered each and are one text of the sample.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).cast("long").alias("_key"), F.coalesce(held_out, F.lit(False)).alias("_held"),
        F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang"),
    )
    train = rows.where("not _held and _lang is not null and _text is not null").where(F.col("_text").rlike(r"\p{L}"))
    counts = train.select("_text").mapInPandas(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    n = dict(counts.collect())  # PLACES + 1 rows
    total = n.pop(-1, 0)
    idf = np.array([np.log((1 + total) / (1 + n.get(i, 0))) + 1 for i in range(PLACES)], np.float32)
    # the lowest hashes of each language: a share of the hash range that holds `sample` distinct texts or more
    hashed = train.select("_lang", "_text", F.shiftrightunsigned(F.xxhash64("_text"), 1).alias("h"))
    per = hashed.select("_lang", "h").distinct().groupBy("_lang").agg(F.count(F.lit(1)).alias("_texts"))
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("_texts"))
    per = checkpoint(per.select("_lang", share.alias("_share")))  # a row per language
    if per.count() <= MAX_LANGS:
        per = F.broadcast(per)  # training texts are cut to the sample before they are dealt by language
    low = hashed.join(per, "_lang")
    low = low.where(F.col("h") <= F.col("_share") * float((1 << 63) - 1)).groupBy("_lang", "h").agg(F.first("_text").alias("_text"))
    fitted = checkpoint(low.groupBy("_lang").applyInPandas(_fit(idf, k, sample), "lang string, lowest double, centre binary"))
    if fitted.count() * PLACES * 4 > MAX_MODEL:
        raise ValueError("too many languages to send all centroids to every task: raise MAX_MODEL or lower k")
    found = fitted.orderBy("lang", "centre").collect()
    centres = np.stack([np.frombuffer(r["centre"], np.float32) for r in found]) if found else np.zeros((0, PLACES), np.float32)
    model = ([r["lang"] for r in found], np.array([r["lowest"] for r in found]), centres)
    out = rows.select("_key", "_held", "_text").mapInPandas(_predict(model, idf), _SCHEMA)
    return out.withColumnRenamed("_key", key)
