"""Queries over markup trees: the stored trees, and pages parsed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import dom
from termloom.sources.tables import table


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "yomu")


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "page").where("id is not null and wiki_page is not null").groupBy("id").agg(F.min("wiki_page").alias("wiki_page"))
    return dom.parse_pages(pages, "id", "wiki_page")


def tag_counts(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).groupBy(dom.clean_tag().alias("tag")).agg(F.count("*").alias("n"))


def child_links(spark: SparkSession, d: str) -> DataFrame:
    """Links right under a paragraph."""
    return dom.children(_nodes(spark, d), "p", "a").select("page_id", "node_id", dom.attr("href").alias("href"))


def descendant_emphasis(spark: SparkSession, d: str) -> DataFrame:
    return dom.descendants(_nodes(spark, d), "page em").select("page_id", "node_id")


def first_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return dom.first_match(_nodes(spark, d), "p")


def last_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return dom.first_match(_nodes(spark, d), "p", last=True)


def without_class(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs not marked empty."""
    return _nodes(spark, d).where(dom.matches("p!.mw-empty-elt")).select("page_id", "node_id")


def class_members(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by each class they have."""
    return _nodes(spark, d).select("node_id", F.explode(F.array_distinct(F.split(dom.attr("class"), r"\s+"))).alias("class")).where("class != ''")


def node_attributes(spark: SparkSession, d: str) -> DataFrame:
    with_id = dom.with_attr("id", "x")
    return _nodes(spark, d).select("node_id", dom.attr("src").alias("src"), dom.attr("href").alias("href"), F.coalesce(F.size(with_id), F.lit(-1)).alias("with_id"))


def texts_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """Own text of headings, without the places of children."""
    return _nodes(spark, d).where(dom.clean_tag().isin("h1", "h2", "title")).select("node_id", F.trim(F.replace("data", F.lit("<>"), F.lit(""))).alias("text"))


def deep_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of every node with its children's in their places, styles left out."""
    return dom.read_text(_nodes(spark, d).where("page_id is not null"), skip="style").select("node_id", "text")


def parents(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    up = n.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("parent_tag"))
    return n.select("page_id", "node_id", "parent_id").join(up, ["page_id", "parent_id"]).select("node_id", "parent_id", "parent_tag")


def page_cards(spark: SparkSession, d: str) -> DataFrame:
    return dom.cards(_nodes(spark, d))


def merged_roots(spark: SparkSession, d: str) -> DataFrame:
    out = dom.merge_under(_nodes(spark, d).where("page_id is not null"))
    return out.select("page_id", "node_id", "parent_id", F.col("depth").cast("int").alias("depth"), F.col("ord").cast("int").alias("ord"))


def parsed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d)


def parsed_headings(spark: SparkSession, d: str) -> DataFrame:
    """The first heading of each page, parsed from its markup."""
    n = _parsed(spark, d).where(dom.matches("h1"))
    return n.groupBy("page_id").agg(F.min_by("data", "node_id").alias("heading"))


def parsed_styles(spark: SparkSession, d: str) -> DataFrame:
    """How many style elements each page has."""
    return _parsed(spark, d).where(dom.matches("style")).groupBy("page_id").agg(F.count("*").alias("styles"))


QUERIES = {f.__name__: f for f in (tag_counts, child_links, descendant_emphasis, first_paragraph, last_paragraph, without_class, class_members, node_attributes, texts_by_tag, deep_text, parents, page_cards, merged_roots, parsed_nodes, parsed_headings, parsed_styles)}

_T = "lower(regexp_replace(trim(tag), '/$', ''))"


def _at(name: str) -> str:
    return f"coalesce(list_filter(list_transform(range(1, coalesce(len(attribute), 0) + 1, 2), lambda i: CASE WHEN lower(attribute[i]) = '{name}' THEN coalesce(attribute[i + 1], '') END), lambda v: v IS NOT NULL)[1], '')"


_PAGES = "pg AS (SELECT id AS page_id, min(wiki_page) AS w FROM page WHERE id IS NOT NULL AND wiki_page IS NOT NULL GROUP BY 1)"
#: Levels that the SQL of deep_text spells out, from the deepest.
_DEPTH = 12


def _deep_text() -> str:
    ctes = [f"n AS (SELECT page_id, node_id, parent_id, depth, ord, string_split(coalesce(data, ''), '<>') AS parts, coalesce({_T} <> 'style', true) AS keep FROM yomu WHERE page_id IS NOT NULL)"]
    for k in range(_DEPTH, -1, -1):
        below = f"SELECT page_id, parent_id, list(text ORDER BY ord, text) AS kids FROM l{k + 1} GROUP BY 1, 2" if k < _DEPTH else "SELECT page_id, parent_id, [''] AS kids FROM n WHERE false"
        whole = "array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i < len(parts) THEN coalesce(kids[i], '') ELSE '' END), '')"
        ctes.append(f"l{k} AS (SELECT n.page_id, n.node_id, n.parent_id, n.ord, CASE WHEN keep THEN {whole} ELSE '' END AS text FROM n LEFT JOIN ({below}) b ON b.page_id = n.page_id AND b.parent_id = n.node_id WHERE depth = {k})")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT node_id, text FROM l{k}" for k in range(_DEPTH + 1))


ORACLES = {
    "deep_text": _deep_text(),
    "tag_counts": f"SELECT {_T} AS tag, count(*) AS n FROM yomu GROUP BY 1",
    "child_links": f"SELECT c.page_id, c.node_id, c.href FROM (SELECT *, {_T} AS t, {_at('href')} AS href FROM yomu) c JOIN (SELECT page_id, node_id, {_T} AS t FROM yomu) p ON p.page_id = c.page_id AND p.node_id = c.parent_id WHERE p.t = 'p' AND c.t = 'a'",
    "descendant_emphasis": f"""WITH RECURSIVE t AS (SELECT page_id, node_id, parent_id, {_T} AS t FROM yomu), up AS (SELECT page_id, node_id, parent_id AS up FROM t WHERE parent_id IS NOT NULL
 UNION SELECT u.page_id, u.node_id, t.parent_id FROM up u JOIN t ON t.page_id = u.page_id AND t.node_id = u.up WHERE t.parent_id IS NOT NULL)
SELECT DISTINCT t.page_id, t.node_id FROM t JOIN up USING (page_id, node_id) JOIN t a ON a.page_id = t.page_id AND a.node_id = up.up WHERE t.t = 'em' AND a.t = 'page'""",
    "first_paragraph": f"SELECT page_id, min(node_id) AS node_id FROM yomu WHERE {_T} = 'p' GROUP BY 1",
    "last_paragraph": f"SELECT page_id, max(node_id) AS node_id FROM yomu WHERE {_T} = 'p' GROUP BY 1",
    "without_class": f"SELECT page_id, node_id FROM yomu WHERE {_T} = 'p' AND NOT list_contains(regexp_split_to_array({_at('class')}, '\\s+'), 'mw-empty-elt')",
    "class_members": f"SELECT DISTINCT node_id, class FROM (SELECT node_id, unnest(regexp_split_to_array({_at('class')}, '\\s+')) AS class FROM yomu) WHERE class <> ''",
    "node_attributes": f"SELECT node_id, {_at('src')} AS src, {_at('href')} AS href, CAST(CASE WHEN attribute IS NULL THEN -1 WHEN len(list_filter(range(1, len(attribute) + 1, 2), lambda i: attribute[i] = 'id')) > 0 THEN len(attribute) ELSE len(attribute) + 2 END AS INTEGER) AS with_id FROM yomu",
    "texts_by_tag": f"SELECT node_id, trim(replace(data, '<>', '')) AS text FROM yomu WHERE {_T} IN ('h1', 'h2', 'title')",
    "parents": "SELECT n.node_id, n.parent_id, p.tag AS parent_tag FROM yomu n JOIN yomu p ON p.page_id = n.page_id AND p.node_id = n.parent_id",
    "page_cards": f"""WITH t AS (SELECT *, {_T} AS t, {_at('src')} AS src, list_contains(regexp_split_to_array({_at('class')}, '\\s+'), 'thumbimage') AS thumb, list_contains(regexp_split_to_array({_at('class')}, '\\s+'), 'mw-empty-elt') AS empty_, trim(replace(data, '<>', '')) AS own FROM yomu),
i AS (SELECT page_id, arg_min(substr(src, 3), (NOT thumb, node_id)) AS image FROM t WHERE t = 'img' GROUP BY 1), p AS (SELECT page_id, arg_min(own, node_id) AS intro FROM t WHERE t = 'p' AND length(own) >= 4 AND NOT empty_ GROUP BY 1)
SELECT g.page_id, coalesce(image, '') AS image, coalesce(intro, 'Description not available.') AS intro FROM (SELECT DISTINCT page_id FROM yomu WHERE page_id IS NOT NULL) g LEFT JOIN i USING (page_id) LEFT JOIN p USING (page_id)""",
    "merged_roots": """SELECT page_id, node_id, parent_id, CAST(depth + 1 AS INTEGER) AS depth, ord FROM yomu WHERE page_id IS NOT NULL AND parent_id IS NOT NULL
UNION ALL SELECT page_id, node_id, -1, CAST(depth + 1 AS INTEGER), CAST(row_number() OVER (PARTITION BY page_id ORDER BY node_id) - 1 AS INTEGER) FROM yomu WHERE page_id IS NOT NULL AND parent_id IS NULL
UNION ALL SELECT DISTINCT page_id, -1, NULL::BIGINT, 0, 0 FROM yomu WHERE page_id IS NOT NULL AND parent_id IS NULL""",
    "parsed_headings": f"WITH {_PAGES} SELECT page_id, regexp_extract(w, '(?is)<h1[^>]*>(.*?)</h1>', 1) AS heading FROM pg WHERE regexp_matches(w, '(?i)<h1[ >]')",
}
