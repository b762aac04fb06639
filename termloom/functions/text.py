"""String functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension, content type, whether binary.
MIME = [("txt", "text/plain", False), ("html", "text/html;charset=UTF-8", False), ("css", "text/css", False), ("js", "text/javascript", False), ("png", "image/png", True), ("jpg", "image/jpeg", True), ("json", "application/json", False)]


def tokenize(text: Column, keep: str = "A-Za-z", delimiter: str = " ", lower: bool = True) -> Column:
    """Splits at the delimiters, drops characters outside ``keep`` (they don't split), lowers ASCII letters, skips
    empties. Null gives null. Lowering comes last: Unicode case folding must not create letters."""
    escaped = "".join("\\" + c if c in "\\^]-[" else c for c in delimiter)
    kept = F.regexp_replace(text, f"[^{keep}{escaped}]", "")
    kept = F.translate(kept, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else kept
    return F.filter(F.split(kept, f"[{escaped}]"), lambda t: t != "")


def first_index(text: Column, char: str) -> Column:
    """0-based, -1 where absent."""
    return F.instr(text, char) - 1


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def base64_text(text: Column) -> Column:
    """Base64 of the UTF-8 bytes, in one line."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "\r\n", "")


def fill_template(template: str, *values: Column) -> Column:
    """Each $ of the template is replaced by the next value, URL-encoded."""
    parts = template.split("$")
    out: list[Column] = [F.lit(parts[0])]
    for part, value in zip(parts[1:], values):
        out += [F.url_encode(value), F.lit(part)]
    return F.concat(*out)


def query_map(query: Column) -> Column:
    """k=v&k=v as a map; of equal keys the first counts."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.split(p, "=", 2))
    keys = F.transform(pairs, lambda p: p[0])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p[0]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p[0].alias("key"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("value"))))


def header_map(headers: Column) -> Column:
    """Lines 'Name: value' as a map."""
    return F.str_to_map(F.regexp_replace(headers, "\r", ""), F.lit("\n"), F.lit(": "))


def request_parts(request: Column) -> Column:
    """verb, url, headers and body of a request's text."""
    head = F.substring_index(request, "\r\n\r\n", 1)
    first = F.split(F.substring_index(head, "\r\n", 1), " ")
    return F.struct(
        F.get(first, F.lit(0)).alias("verb"), F.get(first, F.lit(1)).alias("url"),
        header_map(F.substring(head, F.instr(head, "\r\n") + 2, F.length(head))).alias("headers"),
        F.when(F.instr(request, "\r\n\r\n") > 0, F.substring(request, F.instr(request, "\r\n\r\n") + 4, F.length(request))).otherwise("").alias("body"),
    )


def content_type(name: Column) -> Column:
    """By the last extension; an unknown one is HTML; a name without a dot is JSON if it has brackets or quotes."""
    ext = F.substring_index(name, ".", -1)
    out = F.when(~F.contains(name, F.lit(".")), F.when(name.rlike("[\\[\\]{}\"']"), "application/json").otherwise("text/plain"))
    for e, kind, _ in MIME:
        out = out.when(ext == e, kind)
    return out.otherwise("text/html;charset=UTF-8")


def is_binary(name: Column) -> Column:
    return F.substring_index(name, ".", -1).isin(*[e for e, _, b in MIME if b])


def number_or_zero(text: Column) -> Column:
    """The number a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*([+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0))


def card_text(text: Column) -> Column:
    """Quotes become entities; no-break space entities, tabs, line ends and backslashes become spaces."""
    out = F.replace(F.replace(text, F.lit('"'), F.lit("&ldquo;")), F.lit("&nbsp;"), F.lit(" "))
    return F.translate(out, "\t\n\\\x96", "   -")


def page_envelope(key: Column, title: Column, text: Column) -> Column:
    return F.format_string("<page><id>%s</id><title>%s</title><text>%s</text></page>", key, title, text)


def entity_encode(text: Column) -> Column:
    """Characters beyond ASCII as numeric entities."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c: F.when(c == "", "").when(F.ascii(c) > 127, F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";"))).otherwise(c)), "")
