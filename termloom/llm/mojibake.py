"""Garbled text from wrong character encodings: finding it, and restoring it where possible.

Every candidate reading of a suspicious stretch is described by its length when compressed with a zstandard dictionary
of a language, plus what characters foreign to that language cost, plus the cost of the chain of encodings that leads to
the reading. The shortest description wins; if that is the text as it stands, it stays unchanged.

Two kinds of chains: text written as UTF-8 and read as something else, whose traces obey UTF-8's structure and can be
judged in one word, repeatedly for text garbled twice; and text of one single-byte encoding read as another, which shows
over the suspicious words of a text together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut, release, spread

#: What a text may have been read as, in order of preference; bytes that an encoding leaves undefined are
#: control characters, as common decoders have it.
READ_AS = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "koi8-r", "cp866", "iso8859-2", "iso8859-15")
#: Fixed values: (read as, written as) of single-byte encodings.
SINGLE = tuple((b, a) for b in ("cp1252", "latin-1", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850") for a in ("cp1251", "koi8-r", "cp866", "iso8859-5", "cp1250", "iso8859-2", "cp852", "cp1252", "mac_roman", "cp1253", "cp1254") if a != b)
#: Letters beyond ASCII of some languages. Those of any other are learned from its texts.
LETTERS = {
    "en": "éïë",
    "de": "äöüßÄÖÜ",
    "fr": "àâæçèéêëîïôœùûüÿÀÂÆÇÈÉÊËÎÏÔŒÙÛÜŸ",
    "es": "áéíñóúüÁÉÍÑÓÚÜ",
    "pt": "àáâãçéêíóôõúÀÁÂÃÇÉÊÍÓÔÕÚ",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюяАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
}
COMMON = set("’‘“”„«»–—…¿¡€£©°§№•·ºª\xa0")
_KNOWN = COMMON.union(*LETTERS.values())
#: Signs that don't stand between two letters of a word.
NEVER_INSIDE = "¿¡£€©°§•„"
STEP_COST = 0.6  # bytes for each step of a chain over UTF-8
SINGLE_COST = 3.5  # for a chain between single-byte encodings
EDIT_COST = 0.75  # and for each word that it changes
ALIEN_COST = 3.0  # for a character foreign to the language
WORD_BONUS = 2.0  # for a word that a frequent one results from
SWITCH_COST = 1.0  # for a word in another language than its text
DICT_BYTES = 65_536  # of a dictionary
FREQUENT = 400  # words of a language
ALPHABET_SHARE = 0.03  # a character of so many of a language's texts belongs to its alphabet
LANGUAGE_SHARE = 0.001  # a language with fewer of all texts isn't learned
FORM_SHARE = PAIR_SHARE = 0.00001  # a form, or a pair of letters, of so many of a language's is one of the language
LONG = 24  # a word of more characters, as where no spaces are written, counts by its pairs of characters
COUNT_CHARS = 8_000_000  # characters counted at once
LIKELY = 0.8  # of the letter pairs that a text in another script must share with its language

_RUN = re.compile(r"[^\x00-\x7f]+")
_TOKEN = re.compile(r"[^ \t\r\n]+")
_WORD = re.compile(r"[^\W\d_]+")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")
_LATIN = re.compile(r"[A-Za-z]")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")
_MIXED_CASE = re.compile(r"[а-яё][А-ЯЁ]")
#: ASCII and marks of which no encoding of READ_AS makes UTF-8: a text of these alone has no traces.
_PLAIN = re.compile("[\x00-\x7f’‘“”«»–—…]*")
_INSIDE = re.compile(rf"(?<=[^\W\d_])[{NEVER_INSIDE}](?=[^\W\d_])")
_EDGE = ",.;:!?«»„“”\"()"
_UNIT = re.compile(r"\b(?:[kcdmµ]?m|[xyzn\d])[²³¹](?!\w)", re.I)


@lru_cache
def _table(name: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for b in range(256):
        try:
            c = bytes([b]).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    return out


@lru_cache
def _chars(name: str) -> list[str]:
    out = [""] * 256
    for c, b in _table(name).items():
        out[b] = c
    return out


def _bytes_of(text: str, name: str) -> bytes | None:
    table = _table(name)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


@lru_cache(maxsize=1 << 16)
def utf8_readings(run: str, known: frozenset[str] = frozenset(_KNOWN)) -> tuple[tuple[str, str], ...]:
    """(read as, text) for each encoding under which a run of non-ASCII characters is the bytes of UTF-8 text. The start
    of a punctuation mark's three bytes whose last is lost is a trace too; it reads as U+FFFD."""
    out = []
    for name in READ_AS:
        raw = _bytes_of(run, name)
        if raw is None:
            continue
        try:
            got = raw.decode("utf-8")
        except UnicodeDecodeError as e:
            if raw[e.start :] not in (b"\xe2\x80", b"\xe2\x82", b"\xe2\x84"):
                continue
            got = raw[: e.start].decode("utf-8") + "�"
        if all(c in known for c in run) and any(c.isalpha() and c not in known for c in got):
            continue  # letters and marks as they are meant, which happen to be the bytes of a letter unknown here
        if all(g != got for _, g in out):
            out.append((name, got))
    return tuple(out)


def counts(texts: Iterable[tuple[str | None, str | None]]) -> Counter:
    """Of (text, language) pairs: (language, 't', '') of texts, (language, 'c', character) of texts that have a character
    beyond ASCII, (language, 'w', word) of words, (language, 'f', form) of words with their capitals, of long ones their
    pairs of characters, (language, 'p', pair) of letter pairs. Texts with traces of a wrong encoding don't count."""
    out: Counter = Counter()
    forms: dict[str, Counter] = {}
    for text, lang in texts:
        if not text or not lang:
            continue
        if not text.isascii():
            if not _PLAIN.fullmatch(text) and has_traces(text):
                continue
            out.update((lang, "c", c) for c in set(text) if c > "\x7f")
        out[lang, "t", ""] += 1
        forms.setdefault(lang, Counter()).update(text.split())
    for lang, seen in forms.items():
        for w, n in seen.items():
            form = w.strip(_EDGE)
            out[lang, "w", w.lower().strip(_EDGE)] += n
            if 0 < len(form) <= LONG:
                out[lang, "f", form] += n
            elif not form.isascii():  # links and data are no language's
                for i in range(len(form) - 1):
                    out[lang, "f", form[i : i + 2]] += n
            for p in _letter_pairs(form):
                out[lang, "p", p] += n
    return out


class Model:
    """Per language a zstandard dictionary, the alphabet beyond ASCII, the most frequent words, and the pairs of letters.

    All come from ``seen``, the counts over all texts; without them, from the counts of ``texts`` by language."""

    def __init__(self, texts: dict[str, list[str]] | None = None, seen: Counter | None = None):
        self.raw, self.alphabet, self.words, self.pairs = {}, {}, {}, {}
        if seen is None:
            seen = counts((t, lang) for lang, own in (texts or {}).items() for t in own)
        of: dict[tuple[str, str], list[tuple[int, str]]] = {}
        for (lang, kind, item), n in seen.items():
            of.setdefault((lang, kind), []).append((-n, item))
        size = {k: -sum(n for n, _ in v) for k, v in of.items()}
        often = lambda lang, kind, share: [(-n, x) for n, x in of.get((lang, kind), []) if -n >= max(2, share * size[lang, kind])]
        for lang in sorted({k for k, _ in of} | set(LETTERS)):
            least = max(2, ALPHABET_SHARE * size.get((lang, "t"), 0))
            self.alphabet[lang] = frozenset(LETTERS.get(lang, "")) | frozenset(c for n, c in of.get((lang, "c"), []) if -n >= least) | COMMON
            self.words[lang] = frozenset(w for _, w in sorted(of.get((lang, "w"), []))[:FREQUENT])
            # among all texts, what wrong encodings make of a language's words is frequent too
            self.raw[lang] = _dictionary((n, f) for n, f in often(lang, "f", FORM_SHARE) if not self.alien(f, lang))
            self.pairs[lang] = frozenset(p for _, p in often(lang, "p", PAIR_SHARE))
        self.of: dict[str, list[str]] = {}
        for lang, own in self.words.items():
            for w in own:
                self.of.setdefault(w, []).append(lang)
        self.known = frozenset(_KNOWN.union(*self.alphabet.values()))
        self._ready: dict[str, zstandard.ZstdCompressor] = {}

    def likely(self, texts: Iterable[str], lang: str) -> bool:
        """Whether the letter pairs of texts are those of the language."""
        pairs = [p for t in texts for p in _letter_pairs(t)]
        return sum(p in self.pairs[lang] for p in pairs) >= LIKELY * len(pairs)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_ready"} | {"_ready": {}}

    def size(self, text: str, lang: str) -> float:
        """Bytes that describe the text in a language."""
        z = self._ready.get(lang)
        if z is None:
            data = zstandard.ZstdCompressionDict(self.raw[lang]) if self.raw[lang] else None
            params = zstandard.ZstdCompressionParameters.from_level(12, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
            z = self._ready[lang] = zstandard.ZstdCompressor(compression_params=params, dict_data=data)
        return len(z.compress(text.encode("utf-8", "replace"))) + ALIEN_COST * self.alien(text, lang)

    def alien(self, text: str, lang: str) -> int:
        """Characters foreign to the language, signs inside words among them."""
        own = self.alphabet[lang]
        return sum(1 for c in text if c > "\x7f" and c not in own) + len(_INSIDE.findall(text))

    def bonus(self, token: str, lang: str) -> float:
        """For a word that is frequent in the language."""
        return WORD_BONUS if token.strip(_EDGE).lower() in self.words[lang] else 0.0

    def best(self, text: str, of: str | None = None) -> float:
        """The shortest description over the languages; one that isn't ``of`` costs a switch."""
        return min(self.size(text, lang) + (SWITCH_COST if of and lang != of else 0) for lang in self.raw)

    def language(self, text: str) -> str | None:
        score: dict[str, int] = {}
        for w, n in Counter(text.lower().split()).items():
            for lang in self.of.get(w.strip(_EDGE), ()):
                score[lang] = score.get(lang, 0) + n
        return max(score, key=lambda k: (score[k], k), default=None)


def _letter_pairs(text: str) -> Iterator[str]:
    return (w[i : i + 2] for w in _WORD.findall(text.lower()) for i in range(len(w) - 1))


def _dictionary(forms: Iterable[tuple[int, str]]) -> bytes:
    """Counted forms, those that it saves most to have last, where a dictionary is cheapest to refer to."""
    data = sorted((n * len(b), b) for n, f in forms if (b := f.encode("utf-8", "replace")))
    return b"\n".join(b for _, b in data)[-DICT_BYTES:] or b"        "


def has_traces(text: str) -> bool:
    """Whether a text has characters only lost bytes leave, or a run that reads as UTF-8 of letters and signs known here;
    such texts aren't learned from."""
    return bool(_LOST.search(text)) or any(all(c in _KNOWN for c in g) for r in _RUN.findall(text) for _, g in utf8_readings(r))


def _unfold(token: str, model: Model, lang: str | None, depth: int = 3) -> str:
    """Of all chains of readings as UTF-8, the one whose end has the shortest description, its steps included."""
    reached, last = {token: 0}, [token]
    for step in range(1, depth + 1):
        now = []
        for t in last:
            for name in {n for r in _RUN.findall(t) for n, _ in utf8_readings(r, model.known)}:
                def read(m: re.Match, name: str = name) -> str:
                    return next((g for n, g in utf8_readings(m[0], model.known) if n == name), m[0])

                if (new := _RUN.sub(read, t)) not in reached:
                    reached[new] = step
                    now.append(new)
        last = now
    return min(reached, key=lambda t: (model.best(t, lang) + STEP_COST * reached[t], reached[t], t))


def _recode(token: str, chain: tuple[str, str]) -> str | None:
    """The token written and read the other way; of a word whose garbled part ends inside it, that part."""
    chars = _chars(chain[1])
    mixed = any("À" <= c <= "ÿ" for c in token) and _CYRILLIC.search(token)
    out = ""
    for part in re.split("([Ѐ-ӿ]+)", token) if mixed else [token]:
        if mixed and _CYRILLIC.search(part):
            out += part
            continue
        raw = _bytes_of(part, chain[0])
        if raw is None:
            return None
        out += "".join(chars[b] if b > 127 else chr(b) for b in raw)
    if out == token or _LOST.search(out) or _LATIN.search(out) and _CYRILLIC.search(out):
        return None
    return out


def _suspicious(token: str, alphabet: frozenset[str]) -> bool:
    """A word with letters or signs inside that its text's language doesn't have."""
    if _INSIDE.search(token):
        return True
    if not any(c > "\x7f" and c not in alphabet for c in token):
        return False
    bare = _UNIT.sub("", token)
    odd = [i for i, c in enumerate(bare) if c > "\x7f" and c not in alphabet]
    near = lambda i: 0 <= i < len(bare) and bare[i].isalpha()
    return any(bare[i].isalpha() or near(i - 1) or near(i + 1) for i in odd)


def _new_script(read: dict[str, str]) -> bool:
    return any("Ͱ" <= c for g in read.values() for c in g if c.isalpha()) and not any("Ͱ" <= c for t in read for c in t if c.isalpha())


def restore(text: str | None, model: Model) -> tuple[str | None, bool]:
    """The text restored as far as possible, and whether it has traces of a wrong encoding.

    Null, empty and ASCII texts stay and have none. Lost characters (U+FFFD and control characters that only wrong
    decoding leaves) are traces that can't be restored.
    """
    if not text or text.isascii() or _PLAIN.fullmatch(text):
        return text, False
    found = bool(_LOST.search(text))
    lang = model.language(text)
    tokens = {t for t in _TOKEN.findall(text) if not t.isascii()}
    new: dict[str, str] = {}
    for t in tokens:
        if any(utf8_readings(r, model.known) for r in _RUN.findall(t)):
            got = _unfold(t, model, lang)
            if got != t:
                new[t] = got
    alphabet = model.alphabet[lang] if lang else COMMON
    # what only a reading with characters of no known language explains may be explained better below
    weak = {t for t, g in new.items() if any(c > "\x7f" and c.isalpha() and c not in model.known for c in g)}
    odd = [t for t in tokens if (t not in new or t in weak) and "�" not in t and (_suspicious(t, alphabet) or _MIXED_CASE.search(t))]
    if odd:
        here = {t: model.best(new.get(t, t), lang) for t in odd}
        choice, gain = None, 0.0
        for chain in SINGLE:
            read = {t: g for t in odd if (g := _recode(t, chain)) is not None}
            if not read:
                continue
            for to in model.raw:
                own = model.alphabet[to] - COMMON
                if any(c > "\x7f" and c not in own and c not in t for t, g in read.items() for c in g):
                    continue
                won = {t: here[t] - model.size(g, to) + model.bonus(g, to) - (SWITCH_COST if lang and to != lang else 0) - EDIT_COST for t, g in read.items()}
                total = sum(max(v, -2.0) for v in won.values()) - SINGLE_COST
                # another script is no clear gain unless its letters stand together as that language has them
                if total > gain + 1e-9 and (not _new_script(read) or model.likely(read.values(), to)):
                    choice, gain = {t: read[t] for t, v in won.items() if v > -1.5}, total
                    if _new_script(read):  # words all of whose letters became signs go along
                        signs = {t: g for t in tokens if t not in new and t not in read and not any(c.isalpha() for c in t) and (g := _recode(t, chain))}
                        choice |= {t: g for t, g in signs.items() if all(c in own for c in g if c > "\x7f") and model.likely([g], to)}
        if choice:
            new |= choice
    if not new:
        return text, found
    return _TOKEN.sub(lambda m: new.get(m[0], m[0]), text), True


def learn(df: DataFrame, key: str, text: str, lang: str, texts: int | None = None) -> Model:
    """The model of each language, from counts over all texts. The driver gets, of each of at most 1 / LANGUAGE_SHARE
    languages, its FREQUENT words, the characters of its alphabet, and at most 1 / FORM_SHARE forms and 1 / PAIR_SHARE
    letter pairs. ``key`` and ``texts``, by which a sample was drawn before, play no part."""
    code = F.lower(F.substring(F.trim(F.col(lang)), 1, 2))
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), code.alias("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, part in pdf.groupby(pdf["text"].str.len().cumsum() // COUNT_CHARS):
                got = counts(zip(part["text"], part["lang"]))
                yield pd.DataFrame(dict(zip(("lang", "kind", "item"), zip(*got))) | {"n": list(got.values())}, columns=["lang", "kind", "item", "n"])

    seen = rows.mapInPandas(count, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    seen = cut(seen)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    sizes = seen.where("kind in ('t', 'f', 'p')").groupBy("lang").agg(of("t").alias("size"), of("f").alias("forms"), of("p").alias("pairs"))
    total = sizes.agg(F.sum("size").alias("s")).first()["s"] or 0
    sizes = sizes.where(F.col("size") >= LANGUAGE_SHARE * total)
    items = seen.join(F.broadcast(sizes), "lang")  # at most 1 / LANGUAGE_SHARE rows
    least = F.when(F.col("kind") == "c", ALPHABET_SHARE * F.col("size")).when(F.col("kind") == "f", FORM_SHARE * F.col("forms")).when(F.col("kind") == "p", PAIR_SHARE * F.col("pairs"))
    often = items.where((F.col("kind") == "t") | (F.col("kind") != "w") & (F.col("n") >= F.greatest(F.lit(2), least)))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "item")
    words = items.where("kind = 'w'").withColumn("r", F.row_number().over(best)).where(F.col("r") <= FREQUENT).drop("r")
    kept = Counter({(r["lang"], r["kind"], r["item"]): r["n"] for r in often.union(words).collect()})
    release(seen)
    return Model(seen=kept)


def repair(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key``, ``text`` (restored), ``garbled`` (boolean) of every row of ``df``.

    Null and empty texts stay and aren't garbled; texts are read whole; a wrong language only has the
    text counted for it, a null one for none; repeated rows come out as often as they come in; other columns play no part.
    """
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = df.sparkSession.sparkContext.broadcast(learn(src, "key", "text", "lang"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [restore(t, model.value) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "text": [d[0] for d in done], "garbled": np.array([d[1] for d in done], bool)})

    kind = src.schema["key"].dataType.simpleString()
    return spread(src.select("key", "text")).mapInPandas(run, f"key {kind}, text string, garbled boolean").withColumnRenamed("key", key)
