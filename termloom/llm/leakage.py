"""Evaluation texts leaking into training texts, by winnowing.

Of the k-grams of words in each window the one with the smallest hash is kept, on both sides. With k + window - 1 = span
any shared run of ``span`` words shares a kept k-gram. Fingerprints are joined, and every hit is extended over the words
around it: only hits in a common run of ``span`` words or more remain.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import cut, spread

SPAN = 13
K = 5
#: Different test fingerprints up to this number (8 bytes each) go to the executors, to filter the corpus where it is
#: read. Test rows (some 200 bytes each) up to MAX_JOIN are broadcast to the join; more are joined by a shuffle.
MAX_BROADCAST = 1_000_000
MAX_JOIN = 200_000
_WORD = re.compile(r"[^\W_]+")
_HASHES: dict[str, int] = {}
_MANY = 1 << 20


def words(text: str) -> list[str]:
    """Runs of letters and digits, in one case; composed and decomposed letters are the same."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return _WORD.findall(text.lower())


def word_hashes(text: str) -> np.ndarray:
    if len(_HASHES) > _MANY:
        _HASHES.clear()
    out = []
    for w in words(text):
        h = _HASHES.get(w)
        if h is None:
            h = _HASHES[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def kgram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash of each window, the rightmost of equal ones."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    return np.unique(len(grams) - 1 - (view.argmin(1) + np.arange(len(view))))


def _prints(span: int, k: int, kept: Broadcast | None, pad: int):
    """kept: the sorted hashes to keep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        room, only = span - k, kept.value if kept is not None else None
        for pdf in batches:
            ids, prints, around = [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                h = word_hashes(text)
                if len(h) < span:
                    continue
                grams = kgram_hashes(h, k)
                at = winnow(grams, span - k + 1)
                if only is not None:
                    if not len(only):
                        continue
                    g = grams[at]
                    at = at[only[np.minimum(np.searchsorted(only, g), len(only) - 1)] == g]
                if not len(at):
                    continue
                # equal pads would count as equal words: each side has its own
                padded = np.r_[np.full(room, pad, np.uint64), h, np.full(room, pad, np.uint64)]
                around += list(np.lib.stride_tricks.sliding_window_view(padded, 2 * span - k)[at].view(np.int64))
                ids.append(np.full(len(at), i))
                prints.append(grams[at].view(np.int64))
            if ids:
                yield pd.DataFrame({"id": np.concatenate(ids), "print": np.concatenate(prints), "around": around})

    return run


def _side(df: DataFrame, key: str, text: str) -> DataFrame:
    src = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return src.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))


def find_leaks(corpus: DataFrame, tests: DataFrame, corpus_id: str, test_id: str, text: str = "text", span: int = SPAN, k: int = K, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``doc_id``, ``item_id`` of each corpus text with at least ``span`` consecutive words of a test text.

    Null and empty texts, texts under ``span`` words and null ids have no leak; repeated rows give one row; other columns
    play no part. Texts are read whole, whatever their length.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be from 1 to span")
    run = "id long, print long, around array<long>"
    items = _side(tests, test_id, text).mapInPandas(_prints(span, k, None, 1), run)
    items = cut(items.select(F.col("id").alias("item_id"), "print", F.col("around").alias("test_around")))
    small = items.limit(MAX_JOIN + 1).count() <= min(MAX_JOIN, max_broadcast)
    seen = items.select("print").distinct().limit(max_broadcast + 1).toPandas()["print"].to_numpy(np.int64)
    fits = len(seen) <= max_broadcast
    only = corpus.sparkSession.sparkContext.broadcast(np.sort(seen.view(np.uint64))) if fits else None
    docs = spread(_side(corpus, corpus_id, text)).mapInPandas(_prints(span, k, only, 2), run)
    hits = docs.join(F.broadcast(items) if small else items, "print").select(F.col("id").alias("doc_id"), "item_id", "around", "test_around")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                same = np.stack(pdf["around"].to_numpy()) == np.stack(pdf["test_around"].to_numpy())
                runs = np.lib.stride_tricks.sliding_window_view(same, span, axis=1).all(2).any(1)
                yield pdf.loc[runs, ["doc_id", "item_id"]].drop_duplicates()

    return hits.mapInPandas(extend, "doc_id long, item_id long").distinct()
