"""Queries of string, map and request functions, over texts the tables hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.operators.index import tokens
from termloom.plans.index_queries import TOKENS_SQL
from termloom.sources import formats
from termloom.sources.tables import table

#: Status codes of HTTP that the lookup query joins.
STATUS = [(200, "OK"), (201, "Created"), (301, "Moved Permanently"), (304, "Not Modified"), (400, "Bad Request"), (404, "Not Found"), (500, "Internal Server Error")]


def string_functions(spark: SparkSession, d: str) -> DataFrame:
    """Replace, first index, count of a character, base64, over whole texts."""
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.md5(F.replace(t, F.lit("the"), F.lit("<THE>"))).alias("replaced"), tx.first_index(t, "x").alias("first_x"),
        tx.count_char(t, "e").alias("n_e"), F.md5(tx.base64_text(t)).alias("b64"),
    )


def titles_clean(spark: SparkSession, d: str) -> DataFrame:
    """Titles with ampersands, as the card shows them; each page name once."""
    return table(spark, d, "page").where("page_name is not null").select(F.replace("page_name", F.lit("&amp;"), F.lit("&")).alias("title")).distinct()


def image_sources(spark: SparkSession, d: str) -> DataFrame:
    """Image sources without their two leading slashes, with content type and binary flag."""
    from termloom.operators import dom

    src = F.substring(dom.attr("src"), F.lit(3), F.length(dom.attr("src")))
    rows = table(spark, d, "yomu").where(dom.clean_tag() == "img").select("node_id", src.alias("image"))
    return rows.select("node_id", "image", tx.content_type(F.col("image")).alias("content_type"), tx.is_binary(F.col("image")).alias("is_binary"), F.contains("image", F.lit(".")).alias("has_type"))


def query_strings(spark: SparkSession, d: str) -> DataFrame:
    """A query string built from a template per user, and read back."""
    q = tx.fill_template("id=$&age=$&name=$", F.col("id"), F.coalesce(F.col("age").cast("string"), F.lit("")), F.col("unique_id"))
    rows = table(spark, d, "app_user").where("id is not null and unique_id is not null").select("id", q.alias("query"))
    m = tx.query_map(F.col("query"))
    return rows.select("id", "query", m["age"].alias("age"), m["name"].alias("name"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests of users, taken apart."""
    raw = F.concat(F.lit("POST /ur HTTP/1.1\r\nHost: a\r\nAccept: b\r\n\r\nuuid="), F.col("unique_id"))
    parts = table(spark, d, "app_user").where("id is not null and unique_id is not null").select("id", tx.request_parts(raw).alias("r"))
    return parts.select("id", "r.verb", "r.url", F.col("r.headers")["Accept"].alias("accept"), tx.query_map(F.col("r.body"))["uuid"].alias("uuid"))


def page_envelopes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page").where("id is not null and page_name is not null and wiki_page is not null")
    return p.select("id", F.md5(tx.page_envelope(F.col("id"), F.col("page_name"), F.col("wiki_page"))).alias("envelope")).distinct()


def card_texts(spark: SparkSession, d: str) -> DataFrame:
    """Own text of paragraphs, cleaned for a card, beyond-ASCII characters as numeric entities."""
    rows = table(spark, d, "yomu").where("data is not null").select("node_id", tx.card_text(F.col("data")).alias("t"))
    return rows.select("node_id", F.md5("t").alias("card"), F.length(tx.entity_encode(F.col("t"))).alias("encoded_length"))


def numbers_in_titles(spark: SparkSession, d: str) -> DataFrame:
    """The number an id or title starts with, else 0."""
    v = table(spark, d, "document_vector").where("doc_id is not null").groupBy("doc_id").agg(F.max("title").alias("title"))
    return v.select("doc_id", tx.number_or_zero(F.col("doc_id").cast("string")).alias("from_id"), tx.number_or_zero(F.coalesce("title", F.lit(""))).alias("from_title"))


def status_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Events joined to a code|phrase table."""
    lines = spark.createDataFrame([(f"{c}|{p}",) for c, p in STATUS], "value string")
    codes = lines.select(F.substring_index("value", "|", 1).cast("int").alias("code"), F.substring_index("value", "|", -1).alias("phrase"))
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 201).otherwise(200)
    return table(spark, d, "events").select("event_id", code.alias("code")).join(F.broadcast(codes), "code").groupBy("code", "phrase").agg(F.count("*").alias("n"))


def pages_by_name(spark: SparkSession, d: str) -> DataFrame:
    """Equality selection with a bound parameter, never spliced text."""
    table(spark, d, "page").createOrReplaceTempView("termloom_page")
    name = spark.sql("SELECT min(page_name) AS n FROM termloom_page").first()["n"]
    return formats.query_table(spark, "SELECT DISTINCT id, unique_id, page_name FROM termloom_page WHERE page_name = :name", name=name)


def string_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Each page's name as a JSON array of its words, read back to rows with their place."""
    p = table(spark, d, "page").where("id is not null and page_name is not null").select("id", "page_name").distinct()
    packed = p.select("id", "page_name", F.to_json(F.split("page_name", " ")).alias("words"))
    return packed.select("id", "page_name", F.posexplode(formats.parse_string_array("words")).alias("place", "word"))


def map_primitives(spark: SparkSession, d: str) -> DataFrame:
    """Keys, lookup, filter, merge with the later value winning, and values in order, over the stored maps."""
    v = table(spark, d, "document_vector").where("doc_id is not null and map is not null and size(map) > 0").select("doc_id", "map").dropDuplicates(["doc_id"])
    big = F.map_filter("map", lambda k, x: x >= 0.1)
    merged = F.map_zip_with("map", F.transform_values(big, lambda k, x: F.lit(1.0)), lambda k, x, y: F.coalesce(y, x))
    vals = F.array_sort(F.map_values("map"))
    return v.select("doc_id", F.size("map").alias("n"), F.size(big).alias("n_big"), F.round(F.aggregate(F.map_values(merged), F.lit(0.0), lambda s, x: s + x), 7).alias("merged_sum"), F.element_at(vals, 1).alias("least"), F.element_at(vals, -1).alias("most"), F.array_min(F.map_keys("map")).alias("first_key"))


def prefix_matches(spark: SparkSession, d: str) -> DataFrame:
    """Words of the documents of which one starts the other, by explicit prefixes rather than by comparing all pairs."""
    terms = tokens(table(spark, d, "documents")).select("term").distinct()
    prefixes = terms.select(F.col("term").alias("longer"), F.explode(F.transform(F.sequence(F.lit(1), F.length("term") - 1), lambda i: F.substring("term", F.lit(1), i))).alias("term")).where("length(longer) > 1")
    return prefixes.join(terms, "term").select("term", "longer")


def usable_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    from termloom.operators import dom

    own = F.trim(F.replace("data", F.lit("<>"), F.lit("")))
    return table(spark, d, "yomu").where((dom.clean_tag() == "p") & (F.length(own) >= 4) & ~F.coalesce(dom.has_class("mw-empty-elt"), F.lit(False))).select("page_id", "node_id")


def filled_templates(spark: SparkSession, d: str) -> DataFrame:
    """A page template whose delimited keys come from each row; an unknown key is empty."""
    out = F.lit("<h1>{{title}}</h1><i>{{id}}</i>{{gone}}")
    for key in ("title", "id"):
        out = F.replace(out, F.lit("{{" + key + "}}"), F.coalesce(F.col(key), F.lit("")))
    out = F.regexp_replace(out, r"\{\{\w+\}\}", "")
    return table(spark, d, "page").where("id is not null").select("id", F.col("page_name").alias("title")).distinct().select("id", out.alias("html"))


QUERIES = {f.__name__: f for f in (string_functions, titles_clean, image_sources, query_strings, requests, page_envelopes, card_texts, numbers_in_titles, status_phrases, pages_by_name, string_arrays, map_primitives, prefix_matches, usable_paragraphs, filled_templates)}

_T = "lower(regexp_replace(trim(tag), '/$', ''))"
_CLASS = "coalesce(list_filter(list_transform(range(1, coalesce(len(attribute), 0) + 1, 2), lambda i: CASE WHEN lower(attribute[i]) = '{0}' THEN coalesce(attribute[i + 1], '') END), lambda v: v IS NOT NULL)[1], '')"
_EXT = "string_split(image, '.')[-1]"
_Q = "'id=' || url_encode(id) || '&age=' || coalesce(CAST(age AS VARCHAR), '') || '&name=' || url_encode(unique_id)"
ORACLES = {
    "string_functions": "SELECT doc_id, md5(replace(text, 'the', '<THE>')) AS replaced, CAST(instr(text, 'x') - 1 AS INTEGER) AS first_x, CAST(length(text) - length(replace(text, 'e', '')) AS INTEGER) AS n_e, md5(base64(encode(text))) AS b64 FROM documents WHERE text IS NOT NULL",
    "titles_clean": "SELECT DISTINCT replace(page_name, '&amp;', '&') AS title FROM page WHERE page_name IS NOT NULL",
    "image_sources": f"""SELECT node_id, image, CASE WHEN NOT contains(image, '.') THEN CASE WHEN regexp_matches(image, '[\\[\\]{{}}"'']') THEN 'application/json' ELSE 'text/plain' END WHEN {_EXT} = 'txt' THEN 'text/plain' WHEN {_EXT} = 'css' THEN 'text/css' WHEN {_EXT} = 'js' THEN 'text/javascript' WHEN {_EXT} = 'png' THEN 'image/png' WHEN {_EXT} = 'jpg' THEN 'image/jpeg' WHEN {_EXT} = 'json' THEN 'application/json' ELSE 'text/html;charset=UTF-8' END AS content_type, {_EXT} IN ('png', 'jpg') AS is_binary, contains(image, '.') AS has_type
FROM (SELECT node_id, substr({_CLASS.format('src')}, 3) AS image FROM yomu WHERE {_T} = 'img')""",
    "query_strings": f"SELECT id, {_Q} AS query, coalesce(CAST(age AS VARCHAR), '') AS age, unique_id AS name FROM app_user WHERE id IS NOT NULL AND unique_id IS NOT NULL",
    "requests": "SELECT id, 'POST' AS verb, '/ur' AS url, 'b' AS accept, unique_id AS uuid FROM app_user WHERE id IS NOT NULL AND unique_id IS NOT NULL",
    "page_envelopes": "SELECT DISTINCT id, md5('<page><id>' || id || '</id><title>' || page_name || '</title><text>' || wiki_page || '</text></page>') AS envelope FROM page WHERE id IS NOT NULL AND page_name IS NOT NULL AND wiki_page IS NOT NULL",
    "card_texts": """SELECT node_id, md5(t) AS card, CAST(coalesce(list_sum(list_transform(regexp_extract_all(t, '(?s).'), lambda c: CASE WHEN unicode(c) > 127 THEN 3 + length(CAST(unicode(c) AS VARCHAR)) ELSE 1 END)), 0) AS INTEGER) AS encoded_length
FROM (SELECT node_id, translate(replace(replace(data, '"', '&ldquo;'), '&nbsp;', ' '), chr(9) || chr(10) || chr(92) || chr(150), '   -') AS t FROM yomu WHERE data IS NOT NULL)""",
    "numbers_in_titles": "SELECT doc_id, CAST(doc_id AS DOUBLE) AS from_id, coalesce(TRY_CAST(regexp_extract(coalesce(max(title), ''), '^\\s*([+-]?\\d+(?:\\.\\d*)?)', 1) AS DOUBLE), 0) AS from_title FROM document_vector WHERE doc_id IS NOT NULL GROUP BY 1",
    "status_phrases": "SELECT code, phrase, count(*) AS n FROM (SELECT CAST(CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 201 ELSE 200 END AS INTEGER) AS code FROM events) JOIN (VALUES " + ", ".join(f"({c}, '{p}')" for c, p in STATUS) + ") AS s(code, phrase) USING (code) GROUP BY 1, 2",
    "pages_by_name": "SELECT DISTINCT id, unique_id, page_name FROM page WHERE page_name = (SELECT min(page_name) FROM page)",
    "string_arrays": "SELECT id, page_name, CAST(unnest(range(len(w))) AS INTEGER) AS place, unnest(w) AS word FROM (SELECT id, page_name, string_split(page_name, ' ') AS w FROM (SELECT DISTINCT id, page_name FROM page WHERE id IS NOT NULL AND page_name IS NOT NULL))",
    "map_primitives": "SELECT doc_id, CAST(len(v) AS INTEGER) AS n, CAST(len(list_filter(v, lambda x: x >= 0.1)) AS INTEGER) AS n_big, round(list_sum(list_transform(v, lambda x: CASE WHEN x >= 0.1 THEN 1.0::DOUBLE ELSE x END)), 7) AS merged_sum, list_min(v) AS least, list_max(v) AS most, list_min(k) AS first_key FROM (SELECT DISTINCT ON (doc_id) doc_id, map_values(map) AS v, map_keys(map) AS k FROM document_vector WHERE doc_id IS NOT NULL AND map IS NOT NULL AND cardinality(map) > 0)",
    "prefix_matches": f"WITH {TOKENS_SQL}, t AS (SELECT DISTINCT term FROM tok), p AS (SELECT term AS longer, unnest(list_transform(range(1, length(term)), lambda i: substr(term, 1, i))) AS term FROM t) SELECT term, longer FROM p JOIN t USING (term)",
    "usable_paragraphs": f"SELECT page_id, node_id FROM yomu WHERE {_T} = 'p' AND length(trim(replace(data, '<>', ''))) >= 4 AND NOT list_contains(regexp_split_to_array({_CLASS.format('class')}, '\\s+'), 'mw-empty-elt')",
    "filled_templates": "SELECT DISTINCT id, '<h1>' || coalesce(page_name, '') || '</h1><i>' || id || '</i>' AS html FROM page WHERE id IS NOT NULL",
}
