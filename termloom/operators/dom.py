"""Markup trees as rows: parsing, selecting, reading.

A node row has page_id, node_id (in document order), parent_id, depth, ord (place among its siblings), tag, attribute
(names and values in turn) and data (own text, with ``<>`` where a child sits).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.session import cut

#: Elements that never hold others.
VOID = {"img", "input", "br", "hr", "frame", "area", "base", "basefont", "col", "isindex", "link", "meta", "param"}
RAW = {"script", "style"}
NODE_SCHEMA = "page_id string, node_id long, parent_id long, depth int, ord int, tag string, attribute array<string>, data string"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\w[^>]*>|</([A-Za-z][^\s>/]*)[^>]*>|<([A-Za-z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def parse(text: str) -> list[dict]:
    """Nodes of a markup text, the first the root. A close tag closes the nearest open element of its name, and none if
    there is none; void and self-closed elements hold nothing; script and style hold raw text; comments are skipped."""
    root = {"node_id": 0, "parent_id": None, "depth": 0, "ord": 0, "tag": "root", "attribute": [], "data": "", "n": 0}
    nodes, stack, at = [root], [root], 0
    while m := _TOKEN.search(text, at):
        stack[-1]["data"] += text[at : m.start()]
        at = m.end()
        if m[1]:
            names = [n["tag"].lower() for n in stack[1:]]
            if m[1].lower() in names:
                while stack.pop()["tag"].lower() != m[1].lower():
                    pass
        elif m[2]:
            attrs: list[str] = []
            for a in _ATTR.finditer(m[3].removesuffix("/")):
                attrs += [a[1], next((v for v in (a[2], a[3], a[4]) if v is not None), "")]
            top = stack[-1]
            node = {"node_id": len(nodes), "parent_id": top["node_id"], "depth": top["depth"] + 1, "ord": top["n"], "tag": m[2], "attribute": attrs, "data": "", "n": 0}
            top["n"] += 1
            top["data"] += "<>"
            nodes.append(node)
            name = m[2].lower()
            if name in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(text, at)
                node["data"] = text[at : end.start() if end else len(text)]
                at = end.end() if end else len(text)
            elif name not in VOID and not m[3].endswith("/"):
                stack.append(node)
    stack[-1]["data"] += text[at:]
    return nodes


def parse_pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Node rows of each row's markup; null texts give none, an empty text its root."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"page_id": k} | n for k, t in zip(pdf["key"], pdf["text"]) for n in parse(t)]
            out = pd.DataFrame(rows, columns=["page_id", "node_id", "parent_id", "depth", "ord", "tag", "attribute", "data"])
            yield out.astype({"parent_id": "Int64"})

    src = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text is not null")
    return src.mapInPandas(run, NODE_SCHEMA)


def attr(name: str, attribute: Column | None = None) -> Column:
    """The first value of an attribute, '' where there is none."""
    a = F.col("attribute") if attribute is None else attribute
    named = F.transform(a, lambda x, i: F.when((i % 2 == 0) & (F.lower(x) == name), F.coalesce(F.get(a, i + 1), F.lit(""))))
    return F.coalesce(F.get(F.filter(named, lambda v: v.isNotNull()), F.lit(0)), F.lit(""))


def with_attr(name: str, value: str) -> Column:
    """The attributes with one replaced or appended."""
    a = F.col("attribute")
    has = F.exists(F.transform(a, lambda x, i: (i % 2 == 0) & (x == name)), lambda e: e)
    put = F.transform(a, lambda x, i: F.when((i % 2 == 1) & (F.get(a, i - 1) == name), F.lit(value)).otherwise(x))
    return F.when(has, put).otherwise(F.concat(a, F.array(F.lit(name), F.lit(value))))


def clean_tag() -> Column:
    return F.lower(F.rtrim(F.trim(F.col("tag")), F.lit("/")))


def has_class(name: str) -> Column:
    return F.array_contains(F.split(attr("class"), r"\s+"), name)


def matches(selector: str) -> Column:
    """A compound selector (*, tag, .class, #id, each with ! for its negation) as a condition; a missing attribute fails
    a condition and passes its negation."""
    out = F.lit(True)
    for negated, mark, name in re.findall(r"(!?)([.#]?)([\w-]+|\*)", selector):
        if name == "*":
            one = F.lit(True)
        elif mark == ".":
            one = has_class(name)
        elif mark == "#":
            one = attr("id") == name
        else:
            one = clean_tag() == name.lower()
        one = F.coalesce(one, F.lit(False))
        out = out & (~one if negated else one)
    return out


def children(nodes: DataFrame, parent: str, child: str = "*") -> DataFrame:
    """Children that match, of parents that match."""
    up = nodes.where(matches(parent)).select(F.col("page_id").alias("p"), F.col("node_id").alias("up"))
    down = nodes.where(matches(child))
    return down.join(up, (down["page_id"] == up["p"]) & (down["parent_id"] == up["up"])).drop("p", "up")


def ancestors(nodes: DataFrame) -> DataFrame:
    """``page_id``, ``node_id``, ``up``: every node with each of its ancestors, found level by level."""
    links = nodes.where("parent_id is not null").select("page_id", "node_id", "parent_id")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    step = links.select("page_id", "node_id", F.col("parent_id").alias("up"))
    out = step
    further = links.select("page_id", F.col("node_id").alias("up"), F.col("parent_id").alias("next"))
    for _ in range(deepest - 1):
        step = cut(step.join(further, ["page_id", "up"]).select("page_id", "node_id", F.col("next").alias("up")))
        out = out.union(step)
    return out


def descendants(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes that the last part of "a b c" matches, under nodes that the parts before match in turn; each once."""
    *outer, last = selector.split()
    found = nodes.where(matches(last))
    if not outer:
        return found
    above = descendants(nodes, " ".join(outer)).select("page_id", F.col("node_id").alias("up"))
    hit = ancestors(nodes).join(above, ["page_id", "up"]).select("page_id", "node_id").distinct()
    return found.join(hit, ["page_id", "node_id"], "left_semi")


def first_match(nodes: DataFrame, selector: str, last: bool = False) -> DataFrame:
    """``page_id``, ``node_id`` of the first (or last) match of each page in document order."""
    pick = F.max("node_id") if last else F.min("node_id")
    return nodes.where(matches(selector)).groupBy("page_id").agg(pick.alias("node_id"))


def read_text(nodes: DataFrame, skip: str | None = None) -> DataFrame:
    """``page_id``, ``node_id``, ``text``: own text with each child's text in its place; children that match ``skip`` read
    as nothing. Built from the deepest level upwards."""
    keep = F.lit(True) if skip is None else ~matches(skip)
    base = nodes.select("page_id", "node_id", "parent_id", "depth", "ord", F.coalesce("data", F.lit("")).alias("data"), keep.alias("keep"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    below: DataFrame | None = None
    done: DataFrame | None = None
    for depth in range(deepest, -1, -1):
        level = base.where(F.col("depth") == depth)
        if below is None:
            text = level.withColumn("kids", F.array().cast("array<string>"))
        else:
            kids = below.groupBy(F.col("page_id").alias("p"), F.col("parent_id").alias("up")).agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("ks"))
            text = level.join(kids, (level["page_id"] == kids["p"]) & (level["node_id"] == kids["up"]), "left")
            text = text.withColumn("kids", F.coalesce(F.transform("ks", lambda k: k["text"]), F.array().cast("array<string>")))
        parts = F.split("data", "<>")
        whole = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(parts) - 1, F.coalesce(F.get("kids", i), F.lit(""))).otherwise(""))), "")
        level = text.select("page_id", "node_id", "parent_id", "ord", F.when(F.col("keep"), whole).otherwise("").alias("text"))
        below = level = cut(level)  # else each level would be computed again for all above it
        done = level if done is None else done.union(level)
    return done.select("page_id", "node_id", "text")


def merge_under(nodes: DataFrame, tag: str = "root") -> DataFrame:
    """The roots of each page under one new root (node -1)."""
    tops = nodes.where("parent_id is null")
    root = tops.groupBy("page_id").agg(F.count("*").alias("n")).select(
        "page_id", F.lit(-1).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).alias("depth"), F.lit(0).alias("ord"),
        F.lit(tag).alias("tag"), F.array().cast("array<string>").alias("attribute"), F.expr("repeat('<>', cast(n as int))").alias("data"),
    )
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1
    moved = tops.withColumn("ord", place.cast("int")).withColumn("parent_id", F.lit(-1).cast("long"))
    rest = nodes.where("parent_id is not null").unionByName(moved).withColumn("depth", F.col("depth") + 1)
    names = ["page_id", "node_id", "parent_id", "depth", "ord", "tag", "attribute", "data"]
    return rest.select(*names).unionByName(root.select(*names))


def cards(nodes: DataFrame) -> DataFrame:
    """``page_id``, ``image``, ``intro``: the source of the first image of class thumbimage, else of the first image,
    without its two leading characters; the first paragraph of 4 characters or more not marked empty."""
    tag = clean_tag()
    image = nodes.where(tag == "img").groupBy("page_id").agg(F.min_by(F.substring(attr("src"), F.lit(3), F.length(attr("src"))), F.struct((~F.coalesce(has_class("thumbimage"), F.lit(False))).alias("plain"), "node_id")).alias("image"))
    own = F.trim(F.replace("data", F.lit("<>"), F.lit("")))
    intro = nodes.where((tag == "p") & (F.length(own) >= 4) & ~F.coalesce(has_class("mw-empty-elt"), F.lit(False))).groupBy("page_id").agg(F.min_by(own, "node_id").alias("intro"))
    pages = nodes.select("page_id").where("page_id is not null").distinct()
    out = pages.join(image, "page_id", "left").join(intro, "page_id", "left")
    return out.select("page_id", F.coalesce("image", F.lit("")).alias("image"), F.coalesce("intro", F.lit("Description not available.")).alias("intro"))
