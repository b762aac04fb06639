"""Several values packed in one field: one row per posting, with its position.

A field such as ``12,3|15|"18,2"`` holds postings (a document id, often with a frequency) in any of many habits. An
input-output hidden Markov model over the numbers of the field, whose input are the delimiters found between them, is
learned from the whole column by expectation maximisation, and the Viterbi path through the lattice of readings splits
each field. Quoted spans are atoms of the lattice. No habit is written down but a weak prior (PAIRING), for columns of a
few fields.

States: ``I`` an id, ``F`` the frequency of the id before it, ``P`` a quoted span that holds id and frequency.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.session import spread

I, FREQ, PAIR = range(3)
START = "^"
#: Values up to this have a value frequency each; larger ones share one by their number of digits.
SMALL = 64
DIGITS = 20
BUCKETS = 2 * (SMALL + DIGITS) + 1  # single numbers, numbers that are also a pair, pairs only
PAIR_ONLY = BUCKETS - 1
_ATOM = re.compile(r'"([^"\x1e]*)"|\'([^\'\x1e]*)\'|(\d+(?:\.\d+)?)|(\x1e)|((?:[^\d"\'\x1e]|"(?![^"\x1e]*")|\'(?![^\'\x1e]*\'))+)')
_PAIR_IN = re.compile(r"\D*(\d+)(?:\.\d+)?\D+(\d+)(?:\.\d+)?\D*\Z")
_ONE_IN = re.compile(r"\D*(\d+)(?:\.\d+)?\D*\Z")
_GROUPED = re.compile(r"\s*\d{1,3}(?:,\d{3})+(?:\.\d+)?\s*\Z")
#: Characters that a delimiter's class keeps as they are; letters are one class, other characters another.
KEPT = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t\n")
#: Delimiters that rather join an id and its frequency than part two entries; the weight of that belief in uses.
PAIRING, BELIEF = set(",:=/"), 2.0
#: Transitions that a posting list can have: a frequency follows an id only.
_ALLOWED = np.array([[1, 1, 1], [1, 0, 1], [1, 0, 1]], float)


def _int(digits: str) -> int:
    """-1 for what no int64 holds."""
    n = int(digits) if len(digits) < 20 else -1
    return n if n < 2**63 else -1


@lru_cache(maxsize=1 << 16)
def delimiter_class(delim: str) -> str:
    """The kinds of character of a delimiter in the order written, runs of one kind once: a comma is a comma, a word is
    'a', what else there is 'x'. Of more than three kinds in turn the first two and the last count, with what lies between
    as '~~', so that there are some 48,000 classes whatever a column holds between its values."""
    kinds: list[str] = []
    for c in delim:
        k = c if c in KEPT else "a" if c.isalpha() else " " if c.isspace() else "x"
        if not kinds or kinds[-1] != k:
            kinds.append(k)
    return "".join(kinds if len(kinds) <= 3 else [*kinds[:2], "~~", kinds[-1]])


def _bucket(n: np.ndarray) -> np.ndarray:
    big = np.clip(np.floor(np.log10(np.maximum(n, 1).astype(float) + 0.5)).astype(np.int64) + 1, 1, DIGITS) - 1
    big = np.where(n < 0, DIGITS - 1, big)
    return np.where((n >= 0) & (n < SMALL), n, SMALL + big)


@dataclass
class _Atoms:
    """The atoms of a batch of fields, flat: their field, value as one number, pair they may hold, delimiter before."""

    cell: np.ndarray
    one: np.ndarray
    first: np.ndarray
    second: np.ndarray
    bucket: np.ndarray
    delim: list[str] = field(default_factory=list)


def _atoms(texts: list[str]) -> _Atoms:
    cell: list[int] = []
    one: list[int] = []
    first: list[int] = []
    second: list[int] = []
    kind: list[int] = []
    delim: list[str] = []
    at, before, fresh = 0, "", True
    for q1, q2, number, end, other in _ATOM.findall("\x1e".join(t.replace("\x1e", " ") for t in texts)):
        if number:
            n, a, b, k = _int(number.partition(".")[0]), -1, -1, 0
        elif end:
            at, before, fresh = at + 1, "", True
            continue
        elif other:
            before += other
            continue
        else:
            q = q1 or q2
            pair = _PAIR_IN.match(q)
            if _GROUPED.match(q):
                n = _int(re.sub(r"\D", "", q.partition(".")[0]))
                a, b, k = (_int(pair[1]), _int(pair[2]), 1) if pair else (-1, -1, 0)
            elif pair:
                n, a, b, k = -1, _int(pair[1]), _int(pair[2]), 2
            elif m := _ONE_IN.match(q):
                n, a, b, k = _int(m[1]), -1, -1, 0
            else:
                numbers = re.findall(r"\d+", q)
                if not numbers:
                    before += q
                    continue
                for m in numbers:  # no habit known: a quoted span with a list of its own
                    cell.append(at), one.append(_int(m)), first.append(-1), second.append(-1), kind.append(0)
                    delim.append(START if fresh else delimiter_class(before))
                    before, fresh = "", False
                continue
        cell.append(at), one.append(n), first.append(a), second.append(b), kind.append(k)
        delim.append(START if fresh else delimiter_class(before))
        before, fresh = "", False
    one_, kind_ = np.array(one, np.int64), np.array(kind, np.int64)
    bucket = np.where(kind_ == 2, PAIR_ONLY, _bucket(one_) + (SMALL + DIGITS) * (kind_ == 1))
    return _Atoms(np.array(cell, np.int64), one_, np.array(first, np.int64), np.array(second, np.int64), bucket, delim)


def _readings() -> np.ndarray:
    """Which state an atom of each class can have."""
    can = np.zeros((3, BUCKETS))
    can[:2, : 2 * (SMALL + DIGITS)] = 1
    can[PAIR, SMALL + DIGITS :] = 1
    return can


@dataclass(frozen=True)
class SplitModel:
    """What EM learned: log weights of the states' value classes, and of the transitions at each delimiter."""

    emit: np.ndarray
    moves: dict[str, np.ndarray]
    other: np.ndarray

    def tables(self, delims: list[str]) -> np.ndarray:
        return np.array([self.moves.get(d, self.other) for d in delims]).reshape(-1, 3, 3)


def learn_split(classes: pd.DataFrame, rounds: int = 30, least_share: float = 0.01, settle: int = 5) -> SplitModel:
    """EM over the counts of (class of a value, delimiter, class of the next value) of the whole column; ``classes`` has
    left, delim, right, n, where left is -1 at the start of a field. Values of one field's start are ids or pairs.

    EM ends in the best model near its start, so it starts several times: from frequencies that are small, from those that
    may be anything, and from ids that are. The likeliest end counts.

    The prior on a delimiter's moves is sparse: after ``settle`` rounds a move that is under ``least_share`` of the
    delimiter's uses from a state counts as noise. Else an odd value, say a frequency of 2449, would teach the model
    that its delimiter sometimes parts two ids."""
    can = _readings()
    small = np.r_[0.7 ** np.arange(SMALL), 0.5 ** (8 + np.arange(DIGITS))]
    starts = []
    for state in (FREQ, None, I):
        emit = can.copy()
        if state is not None:
            emit[state, : SMALL + DIGITS] *= small
        starts.append(_learn_from(emit / np.maximum(emit.sum(1, keepdims=True), 1e-12), can, classes, rounds, least_share, settle))
    return max(starts, key=lambda x: x[0])[1]


def _learn_from(emit: np.ndarray, can: np.ndarray, classes: pd.DataFrame, rounds: int, least_share: float, settle: int) -> tuple[float, SplitModel]:
    """The log likelihood, with the prior's, and the model that EM reaches from the weights ``emit``."""
    names = sorted(set(classes.delim) - {START})
    code = {d: k for k, d in enumerate(names)}
    prior = np.array([[[0.2, 1, 0.05] if n.strip() in PAIRING else [1, 0.2, 0.5], [1, 0, 0.5], [1, 0, 0.5]] for n in names]).reshape(-1, 3, 3) * BELIEF
    move = prior / np.maximum(prior.sum(2, keepdims=True), 1e-12)
    start = np.array([0.8, 0.0, 0.2])
    share = np.full(3, 1 / 3)
    begins = classes[classes.delim == START]
    pairs = classes[classes.delim != START]
    left, right, n = pairs.left.to_numpy(int), pairs.right.to_numpy(int), pairs.n.to_numpy(float)
    d = pairs.delim.map(code).to_numpy(int) if len(pairs) else np.zeros(0, int)
    b, bn = begins.right.to_numpy(int), begins.n.to_numpy(float)
    fit = 0.0
    for turn in range(rounds):
        got = start[:, None] * emit[:, b]
        fit = float((bn * np.log(np.maximum(got.sum(0), 1e-300))).sum())
        got = got / np.maximum(got.sum(0), 1e-300) * bn
        joint = share[:, None, None] * emit[:, None, :][:, :, left] * move[d].transpose(1, 2, 0) * emit[None][:, :, right]
        fit += float((n * np.log(np.maximum(joint.sum((0, 1)), 1e-300))).sum() + (prior * np.log(np.maximum(move, 1e-300)) * (prior > 0)).sum())
        joint = joint / np.maximum(joint.sum((0, 1)), 1e-300) * n
        start = got.sum(1) + [0.5, 0, 0.5]
        start /= start.sum()
        seen = np.zeros_like(emit)
        for s in range(3):
            np.add.at(seen[s], b, got[s])
            np.add.at(seen[s], left, joint[s].sum(0))
            np.add.at(seen[s], right, joint[:, s].sum(0))
        seen = (seen + 1) * can
        emit = seen / seen.sum(1, keepdims=True)
        share = joint.sum((1, 2)) + 0.5
        share /= share.sum()
        move = np.zeros_like(move)
        np.add.at(move, d, joint.transpose(2, 0, 1))
        overall = (move.sum(0) + 0.01) * _ALLOWED
        overall /= overall.sum(1, keepdims=True)
        move = (move + 0.05 * overall[None] + prior) * _ALLOWED
        move /= move.sum(2, keepdims=True)
        if turn >= settle:
            move = np.where(move < least_share, 1e-9, move) * _ALLOWED
            move /= move.sum(2, keepdims=True)
    if not len(names):
        overall = _ALLOWED / _ALLOWED.sum(1, keepdims=True)
    with np.errstate(divide="ignore"):
        log = lambda x: np.maximum(np.log(x), -1e6)
        moves = {name: log(move[k]) for name, k in code.items()}
        moves[START] = np.repeat(log(start)[None], 3, 0)
        return fit, SplitModel(log(emit), moves, log(overall))


def viterbi_split(texts: list[str], model: SplitModel) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Field, position, id and frequency of each posting of the fields. All fields advance together, an atom a step."""
    a = _atoms(texts)
    total = len(a.cell)
    if not total:
        return (np.zeros(0, np.int64),) * 4
    names, d = np.unique(np.array(a.delim, dtype=object), return_inverse=True)
    move = model.tables(list(names))
    begin = np.flatnonzero(np.r_[True, a.cell[1:] != a.cell[:-1]])
    length = np.diff(np.r_[begin, total])
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    back = np.zeros((total, 3), np.int8)
    score = np.zeros((len(begin), 3))
    steps = int(length[0])
    alive = np.searchsorted(-length, -np.arange(steps), side="left")
    score += move[d[begin]][:, 0] + model.emit[:, a.bucket[begin]].T
    for t in range(1, steps):
        k = alive[t]
        at = begin[:k] + t
        ways = score[:k, :, None] + move[d[at]]
        back[at] = ways.argmax(1)
        score[:k] = ways.max(1) + model.emit[:, a.bucket[at]].T
    state = np.zeros(total, np.int8)
    now = score.argmax(1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        state[at] = now[:k]
        now[:k] = back[at, now[:k]]
    head = state != FREQ
    doc = np.where(state == PAIR, a.first, a.one)[head]
    nxt = np.r_[state[1:] == FREQ, False] & np.r_[a.cell[1:] == a.cell[:-1], False]
    freq = np.where(state == PAIR, a.second, np.where(nxt, np.r_[a.one[1:], 1], 1))[head]
    cell = a.cell[head]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    pos = np.arange(len(cell)) - np.repeat(first, np.diff(np.r_[first, len(cell)])) + 1
    return cell, pos, doc, freq


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        a = _atoms([t for t in pdf["packed"] if t])
        if not len(a.cell):
            continue
        left = np.r_[-1, a.bucket[:-1]]
        out = pd.DataFrame({"left": left, "delim": a.delim, "right": a.bucket})
        out.loc[out.delim == START, "left"] = -1
        yield out.groupby(["left", "delim", "right"]).size().reset_index(name="n").astype({"left": "int32", "right": "int32", "n": "int64"})


def learn_from_column(df: DataFrame, column: str) -> SplitModel:
    """One pass over the whole column. The driver gets the counts of (value class, delimiter class, value class): their
    number depends on how many classes of delimiters the column's habits have, not on its size."""
    counts = (
        df.select(F.col(column).cast("string").alias("packed")).where("packed is not null")
        .mapInPandas(_classes, "left int, delim string, right int, n long")
        .groupBy("left", "delim", "right").agg(F.sum("n").alias("n"))
    )
    return learn_split(counts.toPandas().sort_values(["left", "delim", "right"], ignore_index=True))


def unpack_postings(df: DataFrame, column: str, keep: list[str], model: SplitModel | None = None) -> DataFrame:
    """One row per posting of ``column``: the columns ``keep``, ``pos`` (int, from 1 in the order written), ``doc_id``
    and ``freq`` (bigint, 1 where none is written).

    Null, empty and blank fields, and fields without a digit, give no row; repeated entries each give one, and so do
    repeated rows. A number beyond bigint gives -1. Other columns of ``df`` play no part, whatever their names. The model
    is learned from the whole column unless given.
    """
    src = df.select(*[F.col(k).alias(f"keep{i}") for i, k in enumerate(keep)], F.col(column).cast("string").alias("packed"))
    src = spread(src.where(F.col("packed").isNotNull()))
    learned = model or learn_from_column(src, "packed")
    names = [f"keep{i}" for i in range(len(keep))]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cell, pos, doc, freq = viterbi_split(list(pdf["packed"]), learned)
            out = pdf[names].iloc[cell].reset_index(drop=True)
            out["pos"], out["doc_id"], out["freq"] = pos.astype(np.int32), doc, freq
            yield out

    schema = T.StructType([f for f in src.schema if f.name != "packed"] + [T.StructField("pos", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("freq", T.LongType())])
    out = src.mapInPandas(split, schema)
    return out.select(*[F.col(f"keep{i}").alias(k) for i, k in enumerate(keep)], "pos", "doc_id", "freq")
