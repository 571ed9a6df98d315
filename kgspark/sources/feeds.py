"""Feed files and uploads to documents(feed, doc_id, title, text, authors, categories, url, published)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

MOST_ITEMS, MOST_BYTES = 50, 50 * 1024 * 1024  # fixed values: items of a feed, bytes of an upload
ATOM = "id string, title string, summary string, published string, author array<struct<name: string>>, category array<struct<_term: string>>"
RSS = "guid string, title string, link string, summary string, description string, pubDate string, author array<string>, category array<string>"


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s*\n\s*", " "))


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("feed", F.col("_metadata.file_path"))


def _named(names: Column) -> Column:
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def atom_documents(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: the id is what follows /abs/, line breaks become spaces."""
    e = _xml(spark, path, "entry", ATOM)
    doc_id = F.regexp_replace("id", "^.*/abs/", "")
    authors, terms = F.transform("author", lambda a: a["name"]), F.transform("category", lambda c: c["_term"])
    return e.select("feed", doc_id.alias("doc_id"), _flat(F.col("title")).alias("title"), _flat(F.col("summary")).alias("text"), _named(authors).alias("authors"), _named(terms).alias("categories"), F.col("id").alias("url"), F.coalesce("published", F.lit("")).alias("published"))


def rss_documents(spark: SparkSession, path: str, most: int = MOST_ITEMS) -> DataFrame:
    """The first items of RSS files: the id falls back to the link, the text is the summary or else the description."""
    e = _xml(spark, path, "item", RSS).withColumn("_at", F.monotonically_increasing_id())
    e = e.withColumn("_n", F.row_number().over(W.partitionBy("feed").orderBy("_at"))).where(F.col("_n") <= most)
    filled = lambda a, b: F.coalesce(F.nullif(F.trim(a), F.lit("")), F.trim(b), F.lit(""))
    return e.select("feed", filled("guid", "link").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), filled("summary", "description").alias("text"), _named(F.col("author")).alias("authors"), _named(F.col("category")).alias("categories"), F.coalesce("link", F.lit("")).alias("url"), F.coalesce("pubDate", F.lit("")).alias("published"))


def triage_uploads(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(path, name, title, id, accepted, reason) of binary files (path, length, content): empty, too large and non-PDF ones are refused.

    `name` is the base name with unsafe characters replaced and without outer spaces and dots, ending in .pdf, upload.pdf if nothing is left; `title` is its stem without a leading UUID and underscore.
    """
    name = F.regexp_replace(F.regexp_replace("path", r"^.*[/\\]", ""), r"[^A-Za-z0-9._ -]", "_")
    name = F.regexp_replace(name, r"^[ .]+|[ .]+$", "")
    name = F.when(name == "", F.lit("upload.pdf")).when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    title = F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}_", "")
    reason = F.when(F.coalesce("length", F.lit(0)) == 0, "empty").when(F.col("length") > most, "too large").when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "not a PDF")
    return files.select("path", name.alias("name"), title.alias("title"), F.substring(F.sha2("path", 256), 1, 16).alias("id"), reason.isNull().alias("accepted"), reason.alias("reason"))
