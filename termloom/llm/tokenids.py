"""Encoding a corpus with a public tokenizer, as a monoid tree reduction.

A text is halved until its pieces are short; pieces are encoded; neighbours are joined up the tree. To join, a window
around the seam is encoded anew. The window's ends lie where every pre-token ends whatever stands around it (before a
white space character that follows another character) and where no token of the piece reaches across, so tokens outside
can't change; while it has no such place it grows, at last to the ends of both pieces. Joining is associative, and
decoding concatenates the tokens' bytes.

Tokenizers of two kinds of files are read: those of the tokenizers library (.json), and byte-level ranks of tiktoken
(.tiktoken), which are preferred where a name has both, as they give the same ids in less time. Others are refused.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Pieces up to this many characters are encoded at once.
LEAF = 4096
WINDOW = 64
_LOADED: dict[str, "Encoder"] = {}


#: The pre-tokens of the byte-level vocabularies that come as ranks.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Piece(NamedTuple):
    """Token ids of a piece of text, and where in it each begins and ends (in the units of its encoder)."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class Encoder:
    """Encodes a text of any length by its pieces. Subclasses encode short texts."""

    def leaf(self, text: str) -> list[int]:
        raise NotImplementedError

    def leaves(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def piece(self, text: str) -> Piece:
        raise NotImplementedError

    def size(self, text: str) -> int:
        raise NotImplementedError

    def decode(self, ids: list[int]) -> str:
        raise NotImplementedError

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)).ids.tolist()

    def _encode(self, text: str, start: int, end: int) -> Piece:
        if end - start <= LEAF:
            return self.piece(text[start:end])
        middle = (start + end) // 2
        return self.join(text, start, middle, end, self._encode(text, start, middle), self._encode(text, middle, end))

    def join(self, text: str, start: int, middle: int, end: int, left: Piece, right: Piece) -> Piece:
        """The tokens of text[start:end] from those of its two parts."""
        seam = self.size(text[start:middle])
        a = middle
        while True:
            a = _stable_before(text, start, a)
            low = seam - self.size(text[a:middle])
            keep = int(np.searchsorted(left.ends, low, side="right"))
            if a == start or keep == len(left.ids) or left.starts[keep] >= low:
                break
        b = middle
        while True:
            b = _stable_after(text, b, end)
            high = self.size(text[middle:b])
            skip = int(np.searchsorted(right.starts, high, side="left"))
            if b == end or skip == 0 or right.ends[skip - 1] <= high:
                break
        keep, skip = (0 if a == start else keep), (len(right.ids) if b == end else skip)
        window = self.piece(text[a:b])
        return Piece(
            np.concatenate([left.ids[:keep], window.ids, right.ids[skip:]]),
            np.concatenate([left.starts[:keep], window.starts + low, right.starts[skip:] + seam]),
            np.concatenate([left.ends[:keep], window.ends + low, right.ends[skip:] + seam]),
        )


class JsonEncoder(Encoder):
    """A tokenizer of the tokenizers library; places are characters."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = _byte_letters()
        self.bytes = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}

    def leaf(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def leaves(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def piece(self, text: str) -> Piece:
        e = self.tokenizer.encode(text, add_special_tokens=False)
        at = np.array(e.offsets, np.int64).reshape(-1, 2)
        return Piece(np.array(e.ids, np.int32), at[:, 0], at[:, 1])

    def size(self, text: str) -> int:
        return len(text)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


class RankEncoder(Encoder):
    """Byte-level ranks; places are bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def leaf(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def leaves(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(t) for t in texts]

    def piece(self, text: str) -> Piece:
        ids = np.array(self.encoding.encode_ordinary(text), np.int32)
        ends = np.cumsum(self.length[ids])
        return Piece(ids, ends - self.length[ids], ends)

    def size(self, text: str) -> int:
        return len(text.encode("utf-8", "surrogatepass"))

    def decode(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable bytes stand for themselves, the others for 256 onwards."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _stable(text: str, i: int) -> bool:
    """A pre-token ends before i in any context: white space follows another character."""
    return _white(text[i]) and not _white(text[i - 1])


def _white(c: str) -> bool:
    """White space as the pre-tokens know it: str.isspace() also counts four separators of ASCII."""
    return c.isspace() and not "\x1c" <= c <= "\x1f"


def _stable_before(text: str, start: int, middle: int) -> int:
    """The last stable place before the middle, sought in growing windows, or the start."""
    window, at = WINDOW, middle - 1
    while at > start:
        low = max(start, middle - window)
        while at > low:
            if _stable(text, at):
                return at
            at -= 1
        window *= 2
    return start


def _stable_after(text: str, middle: int, end: int) -> int:
    at = middle + 1
    while at < end:
        if _stable(text, at):
            return at
        at += 1
    return end


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = (JsonEncoder if path.endswith(".json") else RankEncoder)(path)
    return _LOADED[path]


def tokenizer_file(name: str, folder: str = TOKENIZERS) -> str:
    """The file of a tokenizer; an error for one that is missing or of a kind that isn't supported."""
    for kind in (".tiktoken", ".json"):
        if os.path.exists(f"{folder}/{name}{kind}"):
            return f"{folder}/{name}{kind}"
    known = sorted({f.rsplit(".", 1)[0] for f in os.listdir(folder) if f.endswith((".tiktoken", ".json"))}) if os.path.isdir(folder) else []
    raise ValueError(f"no tokenizer {name!r} of a supported kind in {folder}; there are {known}")


def encode_column(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row of ``df``; null and empty texts have an empty list.

    Strings of special tokens in a text are ordinary text. Rows come out as often as they come in; other columns play no
    part. ``folder`` must hold the tokenizer on every executor, and on the driver.
    """
    path = tokenizer_file(name, folder)
    src = spread(df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(path)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            out: list = [None] * len(texts)
            short = [k for k, t in enumerate(texts) if len(t) <= LEAF]
            for k, ids in zip(short, coder.leaves([texts[k] for k in short])):
                out[k] = np.array(ids, np.int32)
            for k, t in enumerate(texts):
                if out[k] is None:
                    out[k] = np.array(coder.encode(t), np.int32)
            yield pd.DataFrame({"key": pdf["key"], "ids": out})

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInPandas(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
