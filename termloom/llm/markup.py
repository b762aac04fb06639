"""Markup residue in text: what elements a text holds, and clean text that keeps structure.

A text is read once from left to right. Headings, lists, code blocks, formulas and tables of HTML, Markdown, wiki and
LaTeX become lines of one plain notation; what stands inside a list, code block, formula or table belongs to it. All
other markup is taken off. Of each line it is known how much text stays, and which kinds of markup went, how much of it.

Line-block distributions decide what comes out. Sums of the stripped markup over sliding windows of lines surge and dive:
the elements are the kinds of markup between. Sums of the text do likewise: text between a surge and the next dive stays,
structure lines always do. A window with little markup for its text is a surge however short, so that plain lines never
go; lines that are next to nothing but markup, as those of link bars, do.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.session import spread

ELEMENTS = ("heading", "list", "code", "formula", "table", "inline")
#: Tags whose text is source text.
SOURCE_TAGS = {"pre", "code", "script", "style"}
#: Element names of HTML and of wiki markup.
TAGS = (
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins isindex kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option "
    "output p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table "
    "tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr "
    "gallery includeonly noinclude nowiki onlyinclude page poem ref references syntaxhighlight templatestyles text timeline"
).split()
_NAMES = "|".join(sorted(TAGS, key=len, reverse=True))
SHARE = 8
HOLE = "\uFFFC"  # stands for the place of a child node
_ATTRS = r"(?:\s+[\w:.-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)|\s+[\w:-]{2,})*"
_LATEX_CODE, _LATEX_MATH = "verbatim|Verbatim|lstlisting|minted|alltt", "equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign"
_LATEX_TABLE, _LATEX_LIST = "tabular|tabularx|longtable|table|tabulary", "itemize|enumerate|description"

#: Elements that begin and end anywhere; the first to begin wins. A cut element ends with the text.
_OPAQUE = re.compile(
    rf"""
    (?P<code> <(?P<c1>pre|syntaxhighlight|source|script|style)\b[^<>]*>(?P<c1b>.*?)(?:</(?P=c1)\s*>|\Z)
      | ^[ ]{{0,3}}(?P<c2>`{{3,}}|~{{3,}})[ ]*[\w+#.-]*[ ]*\n(?P<c2b>.*?)(?:^[ ]{{0,3}}(?P=c2)[`~]*[ ]*(?=\n|{HOLE}|\Z|[ ])|\Z)
      | \\begin\{{(?P<c3>{_LATEX_CODE})\*?\}}(?P<c3b>.*?)(?:\\end\{{(?P=c3)\*?\}}|\Z) )
  | (?P<comment> <!--.*?(?:-->|\Z) )
  | (?P<formula> <(?P<f1>math|chem)\b[^<>]*>(?P<f1b>.*?)(?:</(?P=f1)\s*>|\Z)
      | <(?P<f2>span|div)\b[^<>]*\bclass\s*=\s*["']?[^"'<>]*\bmath\b[^<>]*>(?P<f2b>.*?)(?:</(?P=f2)\s*>|\Z)
      | \\begin\{{(?P<f3>{_LATEX_MATH})\*?\}}(?P<f3b>.*?)(?:\\end\{{(?P=f3)\*?\}}|\Z)
      | (?<![\\$])\$\$(?P<f4b>[^$]+)\$\$ | (?<!\\)\\\[(?P<f5b>(?:(?!\\\[).)+?)\\\] | (?<!\\)\\\((?P<f6b>(?:(?!\\\().)+?)\\\)
      | (?<![\\$\w])\$(?P<f7b>(?![\s\d$])[^$\n]*?(?<![\s\\]))\$(?![\w$]) | (?<![\\$\w])\$(?=\d[^$\n]*[\\^_={{}}+])(?P<f8b>[^$\n]+(?<![\s\\]))\$(?![\w$]) )
  | (?P<table> <(?P<t1>table)\b[^<>]*>.*?(?:</table\s*>|\Z) | ^[:* ]*\{{\|.*?(?:^\|\}}|\Z) | \\begin\{{(?P<t3>{_LATEX_TABLE})\*?\}}.*?(?:\\end\{{(?P=t3)\*?\}}|\Z) )
  | (?P<list> <(?P<l1>ul|ol|dl)\b[^<>]*>.*?(?:</(?P=l1)\s*>|\Z) | \\begin\{{(?P<l2>{_LATEX_LIST})\}}.*?(?:\\end\{{(?P=l2)\}}|\Z) )
  | (?P<heading> <h(?P<h1>[1-6])\b[^<>]*>(?P<h1b>.*?)(?:</h[1-6]\s*>|\Z)
      | \\(?P<h2>part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?(?:\[[^\]\n]*\])?\{{(?P<h2b>[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*)(?:\}}|\Z) )
  | (?P<braces> \{{\{{(?=\s*[^\W\d_]|[#!:]) )
    """,
    re.X | re.S | re.M | re.I,
)
_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}

_WIKI_HEADING = re.compile(r"[ \t]*(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*\Z")
_ATX = re.compile(r" {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*\Z")
_UNDER = re.compile(r" {0,3}(={3,}|-{3,})[ \t]*\Z")
_BULLET = re.compile(r"\s*(?:[*+•-]|\d{1,3}[.)]|[*#]+)[ \t]+(\S.*)\Z|\s*[*#:;]*[*#][ \t]*(\S.*)\Z|;[ \t]*(\S.*)\Z")
_TIGHT = re.compile(r"\s*[*#:;]*[*#](?=[^\s*#\d])")
_TABLE_RULE = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*\Z")
_RULE = re.compile(r"\s*(?:-{4,}|(?:\*\s*){3,}|(?:_\s*){3,})\s*\Z")

_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_TAG = re.compile(rf"<(/?)({_NAMES})(?:{_ATTRS}\s*/?>|(?=[^<>]*=)[^<>\n]*\Z|\s*\Z)", re.I)
_KEEP = lambda m: next((g for g in m.groups() if g is not None), "")
_DROP = lambda m: ""
#: Inline markup and what stays of it.
_INLINE: list[tuple[re.Pattern, Callable[[re.Match], str]]] = [
    (re.compile(r"\[\[(?:File|Image|Category|Datei|Kategorie|Fichier|Catégorie|Archivo|Categoría)\s*:[^\[\]\n]*(?:\]\]|$)", re.I | re.M), _DROP),
    (re.compile(r"\[\[(?![\s\d,.-]+[\],])(?:[^\[\]|\n]*\|)?([^\[\]\n]*)(?:\]\]|$)", re.M), _KEEP),
    (re.compile(r"^ {0,3}\[[^\]\n]+\]:[ \t]*\S+.*$", re.M), _DROP),
    (re.compile(r"!\[([^\]\n]*)\]\([^()\n]*\)"), _KEEP),
    (re.compile(r"\[([^\[\]\n]+)\]\((?:[^()\s]|\([^()\s]*\))+(?:[ \t]+[\"'(][^\n]*?[\"')])?\)"), _KEEP),
    (re.compile(r"(?:\\\*)?\[\^[^\[\]\n]+\]"), _DROP),
    (re.compile(r"\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), _KEEP),
    (re.compile(r"\[(?:https?:|ftp:|mailto:|/)[^\s\]]*[ \t]*([^\]\n]*)\]"), _KEEP),
    (re.compile(r"``(?=[^\s`])([^`'\n]*(?:'(?!')[^`'\n]*)*)''"), _KEEP),
    (re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)"), lambda m: m[2]),
    *[(re.compile(r"(?<![\w'])('{2,5})(?=[^\s'])((?:[^\n']|'(?!'))*?[^\s'])\1(?!')"), lambda m: m[2])] * 2,  # inner, then outer
    (re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^\n*]*[^\s*])\1(?![\w*])"), lambda m: m[2]),
    (re.compile(r"(?<![\w\\])(_{1,3})(?=[^\s_])([^\n_]*[^\s_])\1(?!\w)"), lambda m: m[2]),
    (re.compile(r"~~(?=[^\s~])([^~\n]+)~~"), _KEEP),
    (re.compile(r"\\(?:cite[tp]?|ref|label|footnote|pageref|index)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*(?:\}|$)", re.M), _DROP),
    (re.compile(r"\\href\{[^{}\n]*\}\{([^{}\n]*)(?:\}|$)", re.M), _KEEP),
    (re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)(?:\}|$)", re.M), _KEEP),
    (re.compile(r"\{\\(?:it|bf|em|tt|sc|sl|rm|sf|small|large|Large|tiny)\b[ \t]*([^{}\n]*)(?:\}|$)", re.M), _KEEP),
    (re.compile(r"~?\\([%&$#_{}*\[\]`~^])"), lambda m: (" " if m[0][0] == "~" else "") + m[1]),
    (re.compile(r"^[ \t]{0,3}>(?: ?>)*[ \t]+", re.M), _DROP),
    (re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|FORCETOC)__"), _DROP),
]
_INDENT = re.compile(r"(?:^|(?<=\n))[ \t]*:[ \t:]*\Z")
_PLACE = re.compile(r"\x01(\d+)\x01")
_ANY = re.compile(r"[<&\[{\\$*_`~'#=|>+;:•-]|^[^\S\n]*\d{1,3}[.)]\s", re.M)


class Line(NamedTuple):
    """A line of the stripped text: its kind ('' for running text), what stays, how many characters of markup went, and
    the kinds of elements they were of."""

    kind: str
    text: str
    markup: int = 0
    elements: frozenset[str] = frozenset()


_INLINE_ONLY = frozenset(["inline"])


def _both(x: Line | None, y: Line | None) -> Line:
    """The first with the markup of the second."""
    if x is None or y is None:
        return x or y
    return x._replace(markup=x.markup + y.markup, elements=x.elements | y.elements)


def _without_inline(text: str) -> str:
    """The text without inline markup."""

    def tag(m: re.Match) -> str:
        return "\n" if m[2].lower() in ("br", "p", "div", "hr") else ""

    def entity(m: re.Match) -> str:
        return m[0] if m[1] and m[1] + ";" not in html.entities.html5 else html.unescape(m[0])

    text = _TAG.sub(tag, text)
    for pattern, keep in _INLINE:
        text = pattern.sub(keep, text)
    return _ENTITY.sub(entity, text)


def _inline_lines(text: str) -> list[Line]:
    """The lines of running text, stripped. Where markup holds line ends, all of its lines count as marked."""
    stripped = _without_inline(text)
    if stripped == text:
        return [Line("", x) for x in text.split("\n")]
    before, after = text.split("\n"), stripped.split("\n")
    if len(before) != len(after):
        gone = max(1, -(-abs(len(text) - len(stripped)) // len(after)))
        return [Line("", x, gone, _INLINE_ONLY) for x in after]
    return [Line("", y, max(1, len(x) - len(y)), _INLINE_ONLY) if x != y else Line("", y) for x, y in zip(before, after)]


class _Reader:
    def __init__(self) -> None:
        self.pairs: dict[str, dict[int, int]] = {}

    def closing(self, text: str, tag: str, start: int) -> int | None:
        """The end of the element or braces that open at start and may hold others of their name, None if nothing closes
        them. All of a name are matched in one pass."""
        if tag not in self.pairs:
            found, open_ = {}, []
            pattern = r"(\}\})|\{\{" if tag == "{{" else rf"<(/)?{tag}\b[^<>]*>"
            for m in re.finditer(pattern, text, re.I):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    found[open_.pop()] = m.end()
            self.pairs[tag] = found
        return self.pairs[tag].get(start)

    def read(self, text: str) -> list[Line]:
        """The lines of the text without its markup."""
        blocks: list[Line] = []
        plain: list[str] = []
        gone: dict[int, Line] = {}  # of each line what went from it without a trace
        at = on = 0
        while m := _OPAQUE.search(text, at):
            kind, stop = m.lastgroup if m.lastgroup in ("comment", "braces") else next(k for k in ("code", "formula", "table", "list", "heading", "comment", "braces") if m[k] is not None), m.end()
            plain.append(text[at : m.start()])
            on += text.count("\n", at, m.start())
            body, element, inline = "", kind, True
            if kind == "comment":
                element = "inline"
            elif kind == "braces":
                stop = self.closing(text, "{{", m.start())
                if stop is None:  # cut braces end with their line
                    stop = text.find("\n", m.start())
                    stop = len(text) if stop < 0 else stop
                inner = text[m.end() : stop].removesuffix("}}")
                element = "inline"
                if re.match(r"\s*(?:math|mvar|sfrac|chem)\s*\|", inner, re.I):
                    element, body = "formula", "$" + _without_inline(inner.partition("|")[2].replace("{{=}}", "=")).strip() + "$"
            else:
                if kind in ("list", "table") and (m["l1"] or m["t1"]):
                    stop = self.closing(text, (m["l1"] or m["t1"]).lower(), m.start()) or stop
                body = self._render(kind, m, text[m.start() : stop])
                inline = kind == "formula" and "\n" not in m[0] and _text_beside(text, m.start(), stop)
            if element == "inline":
                gone[on] = _both(gone.get(on), Line("", "", stop - m.start(), _INLINE_ONLY))
                at = max(stop, m.start() + 1)
                continue
            on += 0 if inline else 2
            if not inline:
                plain[-1] = _INDENT.sub("", plain[-1])
            plain.append(f"\x01{len(blocks)}\x01" if inline else f"\n\x01{len(blocks)}\x01\n")
            extra = _INLINE_ONLY if kind == "heading" and _without_inline(m["h1b"] or m["h2b"] or "") != (m["h1b"] or m["h2b"] or "") else frozenset()
            blocks.append(Line(element, body, max(1, stop - m.start() - len(body)), frozenset([element]) | extra))
            at = max(stop, m.start() + 1)
        plain.append(text[at:])
        done: list[Line] = []
        for line in self._lines("".join(plain), gone):
            held = [blocks[int(k)] for k in _PLACE.findall(line.text)]
            if not held:
                done.append(line)
                continue
            kind = held[0].kind if len(held) == 1 and held[0].text and re.fullmatch(r"[ \t:]*\x01\d+\x01[ \t]*", line.text) else line.kind
            text_ = held[0].text if kind and not line.kind else _PLACE.sub(lambda g: blocks[int(g[1])].text, line.text)
            done.append(Line(kind, text_, line.markup + sum(x.markup for x in held), line.elements.union(*[x.elements for x in held])))
        return done

    def _render(self, kind: str, m: re.Match, whole: str) -> str:
        # markup inside belongs to the element
        if kind == "code":
            body = next(b for b in (m["c1b"], m["c2b"], m["c3b"]) if b is not None)
            if m["c1"]:
                body = html.unescape(re.sub(r"</?code\b[^<>]*>", "", body, flags=re.I))
            return "```\n" + body.strip("\n") + "\n```"
        if kind == "formula":
            body = next(m[g] for g in ("f1b", "f2b", "f3b", "f4b", "f5b", "f6b", "f7b", "f8b") if m[g] is not None)
            body = re.sub(r"<[^<>]+>", "", body) if m["f1"] else body
            body = re.sub(r"\\[()\[\]]", "", body) if m["f2"] else body
            return "$" + body.strip() + "$"
        if kind == "heading":
            level = int(m["h1"]) if m["h1"] else _LEVEL[m["h2"].lower()]
            text = m["h1b"] if m["h1"] else m["h2b"]
            return "#" * level + " " + " ".join(_without_inline(text).split())
        if kind == "list":
            items = re.split(r"<(?:li|dt|dd)\b[^<>]*>", whole, flags=re.I)[1:] if whole[0] == "<" else re.split(r"\\item\b(?:\[[^\]]*\])?", whole)[1:]
            items = [re.sub(r"\\(?:begin|end)\{\w+\*?\}", "", i) for i in items]
            return "\n".join("- " + " ".join(_without_inline(i).split()) for i in items if i.strip())
        if whole[0] == "<":
            rows = [re.split(r"<t[dh]\b[^<>]*>", r, flags=re.I)[1:] for r in re.split(r"<tr\b[^<>]*>", whole, flags=re.I)]
        elif whole[0] == "\\":
            inner = re.sub(r"\\(?:begin|end)\{\w+\*?\}(?:\{[^{}]*\})?|\\hline", "", whole)
            rows = [r.split("&") for r in re.split(r"\\\\", inner)]
        else:
            inner = re.sub(r"^[:* ]*\{\|[^\n]*|^\|\}", "", whole, flags=re.M)
            rows = [[c for line in r.split("\n") for c in re.split(r"!!|\|\|", line.strip().lstrip("!|")) if c.strip()] for r in re.split(r"^\|-.*$", inner, flags=re.M)]
        cells = [[" ".join(_without_inline(c).split()) for c in r] for r in rows]
        return "\n".join("| " + " | ".join(r) + " |" for r in cells if any(r))

    def _lines(self, text: str, gone: dict[int, Line]) -> list[Line]:
        """The lines, with the elements that lines make: headings, lists and tables of wiki markup and Markdown."""
        lines = text.split("\n")
        out: list[Line] = []
        running: list[str] = []
        i = first = 0

        def flush() -> None:
            if running:
                got = _inline_lines("\n".join(running))
                if len(got) == len(running):
                    got = [_both(x, gone.get(first + k)) for k, x in enumerate(got)]
                else:
                    lost = [gone[k] for k in range(first, first + len(running)) if k in gone]
                    got = [functools.reduce(_both, lost, x) for x in got]
                out.extend(got)
                running.clear()

        def add(kind: str, line: str, raw: str, at: int, extra: frozenset[str] = frozenset()) -> None:
            out.append(_both(Line(kind, line, max(1, len(raw) - len(line)), frozenset([kind]) | extra), gone.get(at)))

        while i < len(lines):
            line = lines[i].replace(HOLE, " ").rstrip()
            if i + 1 < len(lines) and "|" in line and _TABLE_RULE.match(lines[i + 1].replace(HOLE, " ").strip()):
                flush()
                while i < len(lines) and "|" in lines[i]:
                    if not _TABLE_RULE.match(lines[i].replace(HOLE, " ").strip()):
                        cells = lines[i].replace(HOLE, " ").strip().strip("|").split("|")
                        add("table", "| " + " | ".join(_without_inline(c).strip() for c in cells) + " |", lines[i], i)
                    i += 1
                continue
            n = _list_run(lines, i)
            if n:
                flush()
                for at, x in enumerate(lines[i : i + n], i):
                    g = _BULLET.match(x.replace(HOLE, " ").rstrip())
                    add("list", "- " + _without_inline(next(v for v in g.groups() if v is not None)).strip(), x, at)
                i += n
                continue
            if m := _WIKI_HEADING.match(line) or _ATX.match(line):
                flush()
                text = _without_inline(m[2])
                add("heading", "#" * len(m[1]) + " " + text, line, i, _INLINE_ONLY if text != m[2] else frozenset())
            elif line.strip() and i + 1 < len(lines) and (m := _UNDER.match(lines[i + 1].replace(HOLE, " ").rstrip())) and "\x01" not in line and (i == 0 or not lines[i - 1].strip()):
                flush()
                text = _without_inline(line.strip())
                add("heading", ("# " if m[1][0] == "=" else "## ") + text, line, i, _INLINE_ONLY if text != line.strip() else frozenset())
                i += 1
            elif _RULE.match(line):
                flush()
                out.append(_both(Line("", "", len(line), _INLINE_ONLY), gone.get(i)))
            else:
                first = first if running else i
                running.append(lines[i])
            i += 1
        flush()
        return out


def _text_beside(text: str, start: int, stop: int) -> bool:
    """Whether the line has more than what stands from start to stop."""
    low, high = text.rfind("\n", 0, start) + 1, text.find("\n", stop)
    return bool((text[low:start] + text[stop : len(text) if high < 0 else high]).strip(f" \t:{HOLE}"))


def _list_run(lines: list[str], at: int) -> int:
    """Number of lines from ``at`` that are items of one list, 0 if there is none. A single '#' line is a heading, and
    markers without a space need a second line that has them too."""

    def kind(i: int) -> str:
        if i >= len(lines):
            return ""
        x = lines[i].replace(HOLE, " ").rstrip()
        if re.match(r"\s*\*[ \t]+\S", x) and not _RULE.match(x):
            return "star"
        if re.match(r"\s*(?:[+•-]|\d{1,3}[.)])[ \t]+\S", x):
            return "-" if x.lstrip()[0] in "+•-" else "1"
        if re.match(r"[*#:;]*[*#][ \t]+\S", x):
            return "#" if x[0] == "#" else "wiki"
        if re.match(r";[ \t]*\S.*:", x):
            return ";"
        if _TIGHT.match(x) and not re.match(r"\s*(\*{1,3})[^\s*](?:[^*]*[^\s*])?\1(?![\w*])", x):
            return "tight" + re.match(r"\s*([*#:;]+)", x)[1]
        return ""

    first = kind(at)
    if not first:
        return 0
    n = 1
    while (k := kind(at + n)) and (k == first or {k, first} <= {"star", "wiki"}):
        n += 1
    least = 1 if first in ("star", "wiki", ";") else 2
    return n if n >= least else 0


def line_blocks(lengths: Sequence[int], against: Sequence[int] | None = None, window: int = 3, surge: int = 8) -> list[bool]:
    """Which lines lie between a surge and the next dive of a line-block distribution: the window of lines from one on
    grows to ``surge``, or to 1 / SHARE of what there is ``against`` it; it dives where it has nothing."""
    out, inside = [], False
    block, other = sum(lengths[:window]), sum(against[:window]) if against is not None else 0
    for i, length in enumerate(lengths):
        if block >= surge or against is not None and block and SHARE * block >= other:
            inside = True
        elif not block:
            inside = False
        out.append(inside and length > 0)
        if i + window < len(lengths):
            block += lengths[i + window]
            other += against[i + window] if against is not None else 0
        block -= length
        other -= against[i] if against is not None else 0
    return out


def clean(text: str | None, tag: str | None = None, window: int = 3, surge: int = 8) -> tuple[str, list[str]]:
    """The clean text, and the kinds of markup elements the text holds, in the order of ELEMENTS.

    Null gives '' and no element; the text of a tag for source text comes back as it is.
    """
    if not text:
        return "", []
    if (tag or "").strip().strip("/").lower() in SOURCE_TAGS:
        return text, []
    marked = text.replace("<>", HOLE).replace("\r\n", "\n").replace("\r", "\n").replace("\x01", " ")
    if not _ANY.search(marked):
        return _plain(marked), []  # no markup anywhere: all lines would stay
    lines = _Reader().read(marked)
    markup = [x.markup for x in lines]
    elements = frozenset().union(*[x.elements for x, k in zip(lines, line_blocks(markup, window=window, surge=1)) if k])
    length = [0 if x.kind else len("".join(x.text.replace(HOLE, "").split())) for x in lines]
    keep = line_blocks(length, markup, window, surge)
    kept = [x.text if x.kind or k else "" for x, k in zip(lines, keep)]
    return _plain("\n".join(kept)), [e for e in ELEMENTS if e in elements]


def _plain(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip(" \t") for x in text.replace(HOLE, "").split("\n"))).strip("\n ")


def clean_column(df: DataFrame, key: str, text: str, tag: str | None = None) -> DataFrame:
    """``key``, ``text`` (clean) and ``elements`` (array of string) of every row of ``df``.

    Null and empty texts give '' and an empty array; texts are read whole; repeated rows come out as often as they come
    in; other columns play no part.
    """
    src = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), (F.col(tag).cast("string") if tag else F.lit(None).cast("string")).alias("tag"))
    src = spread(src)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [clean(t, g) for t, g in zip(pdf["text"], pdf["tag"])]
            yield pd.DataFrame({"key": pdf["key"], "text": [d[0] for d in done], "elements": [d[1] for d in done]})

    kind = src.schema["key"].dataType.simpleString()
    return src.mapInPandas(run, f"key {kind}, text string, elements array<string>").withColumnRenamed("key", key)


def markup_elements(df: DataFrame, key: str, text: str, tag: str | None = None) -> DataFrame:
    """``key``, ``element``: one row for each row of ``df`` and each kind of element it holds."""
    return clean_column(df, key, text, tag).select(key, F.explode("elements").alias("element"))
