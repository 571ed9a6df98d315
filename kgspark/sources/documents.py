"""One reader for all kinds of sources: each gives documents(feed, doc_id, title, text, authors, categories, url, published)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.functions.text import doc_id_of
from kgspark.sources.feeds import atom_documents, rss_documents, triage_uploads
from kgspark.sources.pages import extract_pages


def page_documents(pages: DataFrame) -> DataFrame:
    """Documents of pages(page_id, url, html)."""
    none = F.array().cast("array<string>")
    return extract_pages(pages).select(F.col("url").alias("feed"), doc_id_of(F.col("url")).alias("doc_id"), "title", "text", none.alias("authors"), none.alias("categories"), "url", F.lit("").alias("published"))


def upload_documents(spark: SparkSession, path: str) -> DataFrame:
    """Accepted uploads below a folder, with empty texts: reading PDF is left to a model that is passed in elsewhere."""
    files = triage_uploads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)).where("accepted")
    none = F.array().cast("array<string>")
    return files.select(F.col("path").alias("feed"), F.col("id").alias("doc_id"), "title", F.lit("").alias("text"), none.alias("authors"), none.alias("categories"), F.lit("").alias("url"), F.lit("").alias("published"))


def read_documents(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Documents of one kind of source: arxiv_feed (Atom files), rss, web_url (a Parquet table of pages) or pdf_upload (a folder); any other kind is an error."""
    readers = {
        "arxiv_feed": lambda: atom_documents(spark, path),
        "rss": lambda: rss_documents(spark, path),
        "web_url": lambda: page_documents(spark.read.parquet(path)),
        "pdf_upload": lambda: upload_documents(spark, path),
    }
    if kind not in readers:
        raise ValueError(f"unknown kind of source: {kind}")
    return readers[kind]()
