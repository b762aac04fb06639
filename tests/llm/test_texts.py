"""Markup, leakage, encoding with a tokenizer, garbled text."""

import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import leakage, markup, mojibake, tokenids

ITEM = "Name the guild from Coppgate that taught weather records to 17 apprentices under Pemtock until 1885"


@pytest.mark.parametrize("text, want", [
    ("== History ==\n\ntext", ["heading"]), ("Notes\n=====", ["heading"]), ("# One", ["heading"]), ("# one\n# two", ["list"]), ("<H2 CLASS='t'>x</H2>", ["heading"]),
    ("#brackish weir\n#hardy loom", ["list"]), ("#17 and #21 went", []), ("**p points to *q", []), ("Call *123# now.", []), ("**bold** word", ["inline"]),
    ("<ul><li>a <b>x</b></li></ul>", ["list"]), ("```c\n# x\n* y\n```", ["code"]), ("<pre><code>&lt;b&gt;</code></pre>", ["code"]), ("Run `ls` now", ["inline"]),
    ("costs $5 and $12", []), ("Here $x_1^2$ holds", ["formula"]), ("<math>a</math>", ["formula"]), ("{{math|''x'' {{=}} 8}}", ["formula"]), ("{{cite|x}}", ["inline"]),
    ("{| class=x\n|-\n| 1 || 2\n|}", ["table"]), ("a | b\n--- | ---\n1 | 2", ["table"]), ("x <y and z> 3, a < b", []), ("R&D; x", []), ("A &amp; B", ["inline"]),
    ("[[1, 2], [3, 4]] {{1}, {2}}", []), ("[[Home|the vil", ["inline"]), ("6'' by 8''", []), ("''x'' is", ["inline"]), ("C:\\maps\\x", []), ("\\emph{x}", ["inline"]),
    ("a <> b <>", []), ("", []), (None, []), ("<!-- cut", ["inline"]), ("<table><tr><td>1</td></tr>", ["table"]), ("\\begin{verbatim}\n\\emph{x}", ["code"]), ("> said", ["inline"]),
])
def test_elements(text, want):
    assert markup.clean(text)[1] == want


def test_clean_text():
    text, found = markup.clean("<h2>Title</h2>\n\nSome '''bold''' text of a page.\n\n* one\n* two\n\n<pre>\nx = 1\n</pre>\n\n{{Infobox a|b=c}}\n\nMore text <math>x^2</math> here.")
    assert text == "## Title\n\nSome bold text of a page.\n\n- one\n- two\n\n```\nx = 1\n```\n\nMore text $x^2$ here."
    assert found == ["heading", "list", "code", "formula", "inline"]
    assert markup.clean("<b>x</b>", " PRE ") == ("<b>x</b>", [])


def test_bullets_as_the_only_markup():
    assert markup.clean("\u2022 one\n\u2022 two\n\u2022 three") == ("- one\n- two\n- three", ["list"])


TEXT = "A sentence of plain words."
HTML = ("<h2 class='x'>Name &amp; place</h2>\n<p>" + TEXT + "</p>\n<ul><li>one</li><li><b>two</b></li></ul>\n<pre>x = 1\n  y</pre>\n<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>\n<math>x^2</math>\n" + TEXT)
MARKDOWN = f"## Name & place\n\n{TEXT}\n\n- one\n- **two**\n\n```py\nx = 1\n  y\n```\n\na | b\n--- | ---\n1 | 2\n\n$$\nx^2\n$$\n\n[{TEXT}](http://a.b/c)"
WIKI = f"== Name & place ==\n{TEXT}\n* one\n* '''two'''\n<syntaxhighlight lang=c>\nx = 1\n  y\n</syntaxhighlight>\n{{| class=w\n! a !! b\n|-\n| 1 || 2\n|}}\n:<math display=block>x^2</math>\n{{{{cite|n=1}}}}[[Page|{TEXT}]]"
LATEX = "\\section{Name \\& place}\n" + TEXT + "\n\\begin{itemize}\n\\item one\n\\item \\emph{two}\n\\end{itemize}\n\\begin{verbatim}\nx = 1\n  y\n\\end{verbatim}\n\\begin{tabular}{ll}\na & b \\\\ 1 & 2\n\\end{tabular}\n\\[x^2\\]\n\\textit{" + TEXT + "}"


@pytest.mark.parametrize("written, level", [(HTML, 2), (MARKDOWN, 2), (WIKI, 2), (LATEX, 1)])
def test_one_text_in_four_markups(written, level):
    """The same clean text comes out of each, line for line."""
    text, found = markup.clean(written)
    assert [x for x in text.split("\n") if x] == ["#" * level + " Name & place", TEXT, "- one", "- two", "```", "x = 1", "  y", "```", "| a | b |", "| 1 | 2 |", "$x^2$", TEXT]
    assert {"heading", "list", "code", "table", "formula", "inline"} >= set(found) >= {"heading", "list", "code", "table", "formula"}


def test_lines_between_surge_and_dive():
    short = "Hi.\n\nok\n\nx\n\nA longer line with a **bold** word in it.\n\nno"
    assert markup.clean(short)[0] == short.replace("**", "")
    assert markup.clean("<b>Hi</b>") == ("Hi", ["inline"])
    bar = "[a](http://example.org/some/long/path)\n" * 5
    assert markup.clean("Text that stays here.\n\n\n\n\n" + bar + "\n\n\n\n\nAnd text at the end.")[0] == "Text that stays here.\n\nAnd text at the end."
    assert markup.line_blocks([0, 9, 0, 0, 0, 3, 0]) == [False, True, False, False, False, False, False]
    assert markup.line_blocks([3, 0], [0, 0]) == [True, False] and markup.line_blocks([]) == []


def test_elements_come_from_blocks_of_markup(monkeypatch):
    monkeypatch.setattr(markup, "line_blocks", lambda lengths, *a, **k: [False] * len(lengths))
    assert markup.clean("== History ==\n\ntext")[1] == []


@pytest.mark.parametrize("opener", ["\\[", "\\(", "[^", "{{a ", "<ul><ul></ul>", "$1=", "''a ", "<span class=math", "<br a=", "\n", "#", "*", " "])
def test_time_grows_with_the_text(opener):
    took = []
    for size in (20_000, 160_000):
        began = time.process_time()
        markup.clean("z" + opener * (size // len(opener)) + "\n*z*")
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0] + 0.2


def test_long_markup():
    text = ("word " * 200 + "[[a|b]]\n\n") * 200 + "<b" * 3000 + "{{" * 2000 + "$" * 3001 + "[" * 3000
    assert "inline" in markup.clean(text)[1]


def test_markup_table(spark, same):
    rows = [(1, "**x** y", "p"), (1, "**x** y", "p"), (2, None, "p"), (3, "", None), (None, "# T", None), (4, "<b>", "Code ")]
    df = spark.createDataFrame(rows, "node_id long, data string, tag string").selectExpr("*", "1 AS key", "2 AS text", "3 AS elements")
    same(markup.markup_elements(df, "node_id", "data", "tag"), [(1, "inline"), (1, "inline"), (None, "heading")])
    assert markup.markup_elements(df.limit(0), "node_id", "data", "tag").count() == 0


def leaks(spark, texts, items, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS print", "3 AS item_id")
    tests = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").selectExpr("*", "1 AS doc_id")
    return sorted(tuple(r) for r in leakage.find_leaks(docs, tests, "doc_id", "item_id", **more).collect())


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_leaks(spark, bound):
    w = ITEM.split()
    texts = ["Before. " + " ".join(w[1:14]).upper() + " after", " -- ".join(w[:12]), "x\n".join(w), None, "", "word " * 5000 + ITEM + " word" * 5000, " ".join(w[:7] + ["x"] + w[7:])]
    items = [ITEM, None, "", "short item", ITEM + " and more words follow here"]
    want = [(0, 0), (0, 4), (5, 0), (5, 4)]
    assert leaks(spark, texts, items, max_broadcast=bound) == want
    assert leaks(spark, texts, [""], max_broadcast=bound) == [] and leaks(spark, [], [ITEM], max_broadcast=bound) == []


def test_repetitive_texts_leak(spark):
    assert leaks(spark, ["a " * 40], ["a " * 13, "a " * 12]) == [(0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.sampled_from("abcd"), min_size=13, max_size=30))
def test_winnowing_keeps_every_shared_span(left, right):
    h = [leakage.word_hashes(" ".join(x)) for x in (left, right)]
    grams = [leakage.kgram_hashes(x, 5) for x in h]
    kept = [{int(g[i]) for i in leakage.winnow(g, 9)} for g in grams]
    share = any(left[i : i + 13] == right[j : j + 13] for i in range(len(left) - 12) for j in range(len(right) - 12))
    assert not share or kept[0] & kept[1]


needs_tokenizer = pytest.mark.skipif(not os.path.exists(f"{tokenids.TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")


FILES = ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"]


@pytest.fixture(params=FILES)
def coder(monkeypatch, request):
    monkeypatch.setattr(tokenids, "LEAF", 7)
    monkeypatch.setattr(tokenids, "WINDOW", 1)
    return tokenids.encoder(f"{tokenids.TOKENIZERS}/{request.param}")


@needs_tokenizer
@settings(max_examples=200, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r\u00a0\x1c'sdtl.,!1aAbé日🙂\u0301\u2028<|endoftext|>"), st.characters(exclude_categories=["Cs"])), max_size=120))
def test_tree_equals_whole(coder, text):
    ids = coder.encode(text)
    assert ids == coder.leaf(text)
    if coder is not tokenids._LOADED.get(f"{tokenids.TOKENIZERS}/word_bpe_49k.json"):  # which drops case and white space
        assert coder.decode(ids) == text


@needs_tokenizer
@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k"])
def test_token_table(spark, name):
    texts = ["Hello world", "Hello world", "", None, "a" * 20_000, "x y " * 9000, "<|endoftext|>", "日本の灯台。" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS ids")
    got = {r["doc_id"]: list(r["ids"]) for r in tokenids.encode_column(df, "doc_id", "text", name).collect()}
    kind = "tiktoken" if "multi" in name else "json"
    whole = tokenids.encoder(f"{tokenids.TOKENIZERS}/{name}.{kind}")
    assert got == {i: whole.leaf(t or "") for i, t in enumerate(texts)} and len(got[6]) > 1
    assert name != "byte_bpe_50k" or got[0] == [15496, 995]
    assert tokenids.encode_column(df.limit(0), "doc_id", "text", name).count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="piece_bpe_32k"):
        tokenids.tokenizer_file("piece_bpe_32k")


SAMPLES = {
    "en": ["The café keeps a naïve reading of the old harbour’s diary and its library."] * 30, "de": ["Die Brücke wurde früher täglich von Gästen in der schönen Stadt für größte Höhe besucht."] * 30,
    "fr": ["L’été, la rivière déborda près de la façade très abîmée à côté de l’hôtel."] * 30, "pl": ["Później powstała szkoła i młyn, długość trasy wynosi, znana dzięki obiektowi źródło nad rzeką."] * 30,
    "ru": ["Сегодня пристань открыта для посетителей каждый день, книга вышла и быстро разошлась."] * 30,
}


@pytest.fixture(scope="module")
def model():
    return mojibake.Model(SAMPLES)


@pytest.mark.parametrize("clean, wrong, right", [("café", "cp1252", "utf-8"), ("naïve", "mac_roman", "utf-8"), ("Höhe", "cp437", "utf-8"), ("Сегодня", "latin-1", "utf-8"), ("“old”", "latin-1", "utf-8"), ("für", "cp1251", "utf-8")])
def test_one_word(model, clean, wrong, right):
    text = f"This is the {clean.encode(right).decode(wrong)} of the harbour."
    assert mojibake.restore(text, model) == (f"This is the {clean} of the harbour.", True)


def test_twice(model):
    bad = "café".encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.restore(f"The {bad} and its library", model) == ("The café and its library", True)


def test_single_byte_encodings(model):
    for lang, written, read in (("ru", "cp1251", "cp1252"), ("pl", "iso8859-2", "latin-1"), ("ru", "koi8-r", "cp1251")):
        text = SAMPLES[lang][0].replace("’", "'")
        assert mojibake.restore(text.encode(written).decode(read), model) == (text, True), lang


@pytest.mark.parametrize("text", [None, "", "plain", "Âncora de Râmna, Ångby, SÃO e NÃO", "├── a\n│   └── b", "ﬁrst ﬂoor, № 7, ½ litre, 20\xa0°C, ©", "日本の灯台。 🙂👍🏽", "10 m², 5 m³, ± 2", "cafe\u0301 zero\u200bwidth \ufeffmark", "L’été, à l’hôtel; « déjà »", "Лёд и Пётр", "El año, el niño y según", *[s[0] for s in SAMPLES.values()]])
def test_no_case(model, text):
    assert mojibake.restore(text, model) == (text, False)


OTHERS = {
    "el": ["Η παλιά βιβλιοθήκη του λιμανιού είναι ανοιχτή κάθε πρωί για όλους τους επισκέπτες."] * 30, "cs": ["Staré město leží na řece a každý večer zde září světla, přístav je otevřen pro všechny."] * 30,
    "tr": ["Eski liman şehrinde güneş doğarken balıkçılar ağlarını çeker, çocuklar kıyıda oynar."] * 30, "uk": ["Стара бібліотека біля річки відкрита щодня, її відвідують діти й учителі з усієї громади."] * 30,
    "vi": ["Thư viện cũ bên bờ sông mở cửa mỗi ngày, trẻ em và giáo viên đều đến đọc sách."] * 30,
}


def test_languages_of_the_samples():
    """Languages without fixed letters are learned from their texts."""
    model = mojibake.Model(SAMPLES | OTHERS)
    for lang, (text, *_) in OTHERS.items():
        assert mojibake.restore(text.encode().decode("latin-1"), model) == (text, True), lang
        assert mojibake.restore(text, model) == (text, False)
    for lang, written, read in (("el", "cp1253", "cp1252"), ("cs", "cp1250", "cp1252"), ("tr", "cp1254", "cp1252"), ("uk", "cp1251", "cp1252")):
        text = OTHERS[lang][0]
        assert mojibake.restore(text.encode(written).decode(read), model) == (text, True), lang


def test_unsure_texts_stay(model):
    """A language nobody knows isn't turned into another script."""
    bad = OTHERS["el"][0].encode("cp1253").decode("cp1252")
    assert mojibake.restore(bad, model)[0] == bad


def test_plain_marks_are_no_utf8():
    """What is passed over without a look can't have been UTF-8 under any encoding."""
    marks = "’‘“”«»–—…"
    for a in marks:
        assert not mojibake.utf8_readings(a) and all(not mojibake.utf8_readings(a + b) and all(not mojibake.utf8_readings(a + b + c) for c in marks) for b in marks)


def test_sign_inside_a_word():
    model = mojibake.Model(SAMPLES | {"pl": SAMPLES["pl"] + ["Dziś można tu zobaczyć zbiór map, można też wejść na wieżę."] * 30})
    assert mojibake.restore("Dziś mo¿na tu zobaczyć zbiór map", model) == ("Dziś można tu zobaczyć zbiór map", True)
    assert mojibake.restore("¿Cuántos? Sí; 5£, 3€ • 20°C", model)[1] is False


def test_sample_is_drawn_at_any_size(spark, monkeypatch):
    """The bound of the draw is never 0, however many rows there are."""
    df = spark.createDataFrame([(i, t, lang) for lang, ts in SAMPLES.items() for i, t in enumerate(ts)], "id long, text string, lang string")
    model = mojibake.learn(df, "id", "text", "lang", texts=40)
    assert all(model.words[k] and model.alphabet[k] > mojibake.COMMON for k in SAMPLES) and sum(len(v) > 8 for v in model.raw.values()) >= 3
    assert min(1.0, 6000 / 7e12) * 2**63 > 1e9


def test_every_text_is_learned_from(spark):
    """Long texts, words that one of many texts has, and the same from any number of partitions."""
    rows = [(i, " ".join([t] * 150), lang) for lang, ts in (SAMPLES | OTHERS).items() for i, t in enumerate(ts[:3])]
    rows += [(i, "plain words", "en") for i in range(2000)] + [(9, "Żółwinko leży, Żółwinko śpi", "pl")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    one, other = mojibake.learn(df.coalesce(1), "id", "text", "lang", texts=1), mojibake.learn(df.repartition(7), "id", "text", "lang")
    whole = mojibake.Model({k: [t for _, t, lang in rows if lang == k] for k in SAMPLES | OTHERS})
    for name in ("raw", "alphabet", "words", "pairs"):
        assert getattr(one, name) == getattr(other, name) == getattr(whole, name), name
    assert "Żółwinko".encode() in one.raw["pl"] and {"żó", "ół", "nk"} <= one.pairs["pl"]
    text = OTHERS["el"][0]
    assert mojibake.restore(text.encode("cp1253").decode("cp1252"), one) == (text, True)


def test_garbled_forms_are_not_learned():
    model = mojibake.Model(SAMPLES | {"pl": SAMPLES["pl"] * 10 + ["Dziś mo¿na tu zobaczyæ zbiór map."] * 5})
    assert not any(x.encode() in model.raw["pl"] for x in ("mo¿na", "zobaczyæ")) and "zbiór".encode() in model.raw["pl"]


def test_lost_characters(model):
    assert mojibake.restore("caf\ufffd", model) == ("caf\ufffd", True)


def test_repair_table(spark):
    rows = [(i, t, lang) for lang, ts in SAMPLES.items() for i, t in enumerate(ts)] + [(100, "The cafÃ© is open", "en"), (100, "The cafÃ© is open", "en"), (101, None, None), (102, "", "xx"), (None, "x" * 100_000 + " naÃ¯ve", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS key", "false AS garbled")
    got = mojibake.repair(df, "doc_id", "text", "lang").where("garbled or doc_id >= 100").collect()
    assert sorted((r["doc_id"] or 0, (r["text"] or "")[-20:], r["garbled"]) for r in got) == [(0, "x" * 14 + " naïve", True), (100, "The café is open", True), (100, "The café is open", True), (101, "", False), (102, "", False)]
    assert mojibake.repair(df.limit(0), "doc_id", "text", "lang").count() == 0
