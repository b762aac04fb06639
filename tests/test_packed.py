"""The packed-field operator on fields of many habits, and on dirty tables."""

import random
import re

import pandas as pd
import pytest

from termloom.operators.packed import _classes, delimiter_class, learn_split, unpack_postings, viterbi_split

HABITS = {
    "id,freq|": lambda p: "".join(f"{d},{f}|" for d, f in p),
    "flat": lambda p: ",".join(f"{d},{f}" for d, f in p),
    "colon": lambda p: "，".join(f"{d}:{f}" for d, f in p),
    "json": lambda p: "[" + ", ".join(f'["{d}", {f}]' for d, f in p) + "]",
    "quoted": lambda p: "|".join(f'"{d},{f}"' for d, f in p),
    "both": lambda p: " ; ".join(f'"{d}","{f}"' for d, f in p),
    "decimal": lambda p: "|".join(f"{d},{f}.0" for d, f in p),
    "thousands": lambda p: "|".join(f"{d}," + (f'"{f:,}"' if f > 999 else str(f)) for d, f in p),
    "parens": lambda p: "".join(f"({d},{f})" for d, f in p),
    "slash": lambda p: " ".join(f"{d}/{f}" for d, f in p),
    "empties": lambda p: "||".join(f"{d},{f}|;" for d, f in p),
    "some without": lambda p: "|".join(str(d) if f == 1 else f"{d},{f}" for d, f in p),
}


def lists(n, seed=1):
    rng = random.Random(seed)
    return [[(d, rng.choice([1, 1, 1, 2, 2, 3, 5, 9])) for d in sorted(rng.sample(range(100, 9999), rng.randint(1, 30)))] for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    texts = [habit(p) for habit in HABITS.values() for p in lists(60)]
    return learn_split(pd.concat(_classes([pd.DataFrame({"packed": texts})])))


@pytest.mark.parametrize("habit", HABITS)
def test_habit(model, habit):
    want = lists(40, seed=2)
    if habit == "thousands":
        want[0][0] = (want[0][0][0], 2449)
    cell, pos, doc, freq = viterbi_split([HABITS[habit](p) for p in want], model)
    got = [[] for _ in want]
    for c, n, d, f in zip(cell, pos, doc, freq):
        assert n == len(got[c]) + 1
        got[c].append((d, f))
    assert got == want


def test_long_field(model):
    want = [(k, k % 5 + 1) for k in range(100, 30_100)]
    _, pos, doc, freq = viterbi_split([HABITS["id,freq|"](want), "7,2|"], model)
    assert list(zip(doc, freq)) == [*want, (7, 2)] and pos[29_999] == 30_000 and pos[-1] == 1


def test_dirty_table(spark, same):
    rows = [(1, "5,2|9,1|", "x"), (1, "5,2|9,1|", "x"), (2, None, "x"), (3, "", "x"), (4, "  ", None), (None, "7,3|7,3|", "x"), (5, "none", "x")]
    df = spark.createDataFrame(rows, "rep_id long, full_rep string, doc_id string")
    got = unpack_postings(df, "full_rep", ["rep_id"])
    assert got.columns == ["rep_id", "pos", "doc_id", "freq"]
    same(got, [(1, 1, 5, 2), (1, 2, 9, 1), (1, 1, 5, 2), (1, 2, 9, 1), (None, 1, 7, 3), (None, 2, 7, 3)])
    assert unpack_postings(df.limit(0), "full_rep", ["rep_id"]).count() == 0


def test_clashing_columns(spark, same):
    df = spark.createDataFrame([(1, "5,2|", 9, "a", 3)], "pos long, full_rep string, freq long, packed string, keep0 long")
    out = unpack_postings(df.select("*"), "full_rep", ["packed", "keep0"])
    same(out, [("a", 3, 1, 5, 2)])


@pytest.mark.parametrize("habit", ["id,freq|", "colon", "slash"])
def test_column_of_large_frequencies(habit):
    """Frequencies from 40 to 2,500 in every field: nothing says that a frequency is small but the start EM takes first."""
    rng = random.Random(3)
    want = [[(d, rng.randint(40, 2500)) for d in sorted(rng.sample(range(1000, 99_999), rng.randint(1, 12)))] for _ in range(250)]
    texts = [HABITS[habit](p) for p in want]
    model = learn_split(pd.concat(_classes([pd.DataFrame({"packed": texts})])))
    got = [[] for _ in want]
    for c, _, d, f in zip(*viterbi_split(texts, model)):
        got[c].append((d, f))
    assert got == want


def test_delimiters_of_free_text():
    """Whatever stands between values, classes of delimiters stay few, and a habit among them is read all the same."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    odd = [f"{rng.randint(100, 9999)} {rng.choice(words)} {rng.choice(words)}! {rng.randint(100, 9999)}" for _ in range(500)]
    texts = odd + [HABITS["id,freq|"](p) for p in lists(300)]
    counts = pd.concat(_classes([pd.DataFrame({"packed": texts})]))
    assert counts.delim.nunique() < 10 and counts.n.sum() == sum(len(re.findall(r"\d+", t)) for t in texts)
    assert delimiter_class("abc") == "a" and delimiter_class(" , ") == " , " and len(delimiter_class(",;" * 500)) == 5
    want = lists(50, seed=9)
    got = [[] for _ in want]
    for c, _, d, f in zip(*viterbi_split([HABITS["id,freq|"](p) for p in want], learn_split(counts))):
        got[c].append((d, f))
    assert got == want
