"""The engine's text formats: titles, inverted index, clusters, key|value and entity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def title_line(key: Column, title: Column, mag: Column) -> Column:
    """ID:title sumsq"""
    return F.concat(key.cast("string"), F.lit(":"), F.coalesce(title, F.lit("")), F.lit(" "), mag.cast("long").cast("string"))


def parse_titles(lines: DataFrame) -> DataFrame:
    """``doc_id``, ``title``, ``mag`` of lines ``value``; words of a title are parted by single spaces."""
    rest = F.substring(F.col("value"), F.instr("value", ":") + 1, F.length("value"))
    words = F.filter(F.split(rest, " "), lambda w: w != "")
    return lines.where(F.contains("value", F.lit(":"))).select(
        F.substring_index("value", ":", 1).alias("doc_id"),
        F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("title"),
        F.coalesce(F.get(words, F.size(words) - 1).try_cast("double"), F.lit(0.0)).alias("mag"),
    )


def index_line(term: Column, df: Column, full_rep: Column) -> Column:
    """term df:ID,tf|ID,tf|"""
    return F.concat(term, F.lit(" "), df.cast("string"), F.lit(":"), full_rep)


def parse_index(lines: DataFrame) -> DataFrame:
    """``term``, ``df``, ``doc_id``, ``tf``, ``weight`` = tf / df of index lines ``value``."""
    head = F.split(F.substring_index("value", ":", 1), " ")
    posts = F.filter(F.split(F.substring_index("value", ":", -1), r"\|"), lambda p: p != "")
    rows = lines.where(F.contains("value", F.lit(":"))).select(F.get(head, F.lit(0)).alias("term"), F.get(head, F.lit(1)).try_cast("bigint").alias("df"), F.explode(posts).alias("p"))
    rows = rows.select("term", "df", F.substring_index("p", ",", 1).alias("doc_id"), F.substring_index("p", ",", -1).try_cast("bigint").alias("tf"))
    return rows.withColumn("weight", F.try_divide("tf", "df"))


def cluster_line(sqrt_mag: Column, ids: Column) -> Column:
    """sqrt_mag n:ID,ID,"""
    return F.concat(F.format_string("%.8f", sqrt_mag), F.lit(" "), F.size(ids).cast("string"), F.lit(":"), F.array_join(F.transform(ids, lambda i: F.concat(i.cast("string"), F.lit(","))), ""))


def parse_clusters(lines: DataFrame) -> DataFrame:
    """``sqrt_mag``, ``n``, ``ids`` of cluster lines ``value``."""
    head = F.split(F.substring_index("value", ":", 1), " ")
    ids = F.filter(F.split(F.substring_index("value", ":", -1), ","), lambda p: p != "")
    return lines.where(F.contains("value", F.lit(":"))).select(F.get(head, F.lit(0)).try_cast("double").alias("sqrt_mag"), F.get(head, F.lit(1)).try_cast("int").alias("n"), ids.alias("ids"))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    return parse_titles(spark.read.text(path))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_index(spark.read.text(path))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return parse_clusters(spark.read.text(path))


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term != ''")


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """key|value lines, split at the first bar."""
    return spark.read.text(path).select(F.substring_index("value", "|", 1).alias("key"), F.expr("substring(value, instr(value, '|') + 1)").alias("value"))


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Lines of exactly a character and its entity; of equal characters any one counts."""
    parts = F.split(F.trim("value"), " ")
    return spark.read.text(path).where(F.size(parts) == 2).select(F.get(parts, F.lit(0)).alias("char"), F.get(parts, F.lit(1)).alias("entity"))


def parse_string_array(column: str) -> Column:
    """A JSON array of strings."""
    return F.from_json(F.col(column), "array<string>")


def query_table(spark: SparkSession, sql: str, **args: object) -> DataFrame:
    """SQL with bound parameters (:name), never spliced text."""
    return spark.sql(sql, args=args)
