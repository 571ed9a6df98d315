"""Ingestion as batch jobs: documents to chunks with vectors, extracted entities and relations to claims, claims to the graph.

A document is (ws, source_id, seq, doc_id, title, text, authors, categories, url, published). Models are functions passed in:
an extraction model takes windows (ws, doc_id, window, text) to the same with `entities` and `relations`, null where it failed; a resolver
takes names (ws, seq, kind, name) to the same with `canonical`; an embedder is a column function.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions.text import char_windows, chunk_words, document_body
from kgspark.operators.patterns import flag_conflicts, flag_new_conflicts
from kgspark.store import stored
from kgspark.vocab import ENTITY_TYPES, PAPER_LINKS, RELATION_TYPES, UNLINKED

ENTITIES = "array<struct<name: string, type: string, aliases: array<string>>>"
RELATIONS = "array<struct<source: string, target: string, type: string, context: string, confidence: double>>"
DOC = ["ws", "doc_id"]


def source_key(documents: DataFrame) -> Column:
    """What chunks of a document are known by: its url, or its id where it has none."""
    return F.coalesce(F.nullif(documents["url"], F.lit("")), documents["doc_id"].cast("string"))


def hashed_embedding(text: Column, dims: int = 64, size: int = 3) -> Column:
    """A deterministic stand-in for an embedding model: counts of character n-grams by hash, of unit length."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for part in texts:
            out = []
            for t in part.fillna(""):
                raw = t.lower().encode("utf-8", "surrogatepass")
                v = np.bincount([zlib.crc32(raw[i : i + size]) % dims for i in range(max(1, len(raw) - size + 1))], minlength=dims).astype(np.float64)
                out.append((v / (np.linalg.norm(v) + 1e-10)).astype(np.float32))
            yield pd.Series(out)

    return embed(text)


def not_yet_ingested(documents: DataFrame, chunks: DataFrame, force: bool = False) -> DataFrame:
    """Documents of whose source key their own workspace holds no chunks; all with force."""
    if force:
        return documents
    held = chunks.select("ws", F.col("chunk_source").alias("_key")).distinct()
    return documents.withColumn("_key", source_key(documents)).join(held, ["ws", "_key"], "left_anti").select(*documents.columns)


def document_chunks(documents: DataFrame, embedder: Callable[[Column], Column] = hashed_embedding, size: int = 400, overlap: int = 40) -> DataFrame:
    """Chunks of the documents' bodies, with ids `ws:key:index` and vectors."""
    body = document_body(F.coalesce("title", F.lit("")), F.col("text"))
    rows = documents.select("ws", "source_id", source_key(documents).alias("chunk_source"), "title", "url", "published", F.posexplode(chunk_words(body, size, overlap)).alias("chunk_index", "text"))
    return rows.select(
        "ws", "source_id", F.concat_ws(":", "ws", "chunk_source", F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_source", F.coalesce("url", F.lit("")).alias("source_url"),
        F.col("title").alias("source_title"), F.coalesce("published", F.lit("")).alias("source_date"), "chunk_index", "text", embedder(F.col("text")).alias("embedding"),
    )


def upsert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """The chunk table after ingestion: what it held of the new chunks' sources goes, the new ones come, each id once."""
    keys = new.select("ws", "chunk_source").distinct()
    return chunks.join(keys, ["ws", "chunk_source"], "left_anti").select(*new.columns).unionByName(new.dropDuplicates(["ws", "chunk_id"]))


def mark_processed(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Nodes (ws, label, name, ...) with entities_extracted: true for papers among documents, kept where it was true."""
    done = documents.select("ws", F.lit("Paper").alias("label"), F.col("doc_id").cast("string").alias("name"), F.lit(True).alias("_done")).distinct()
    was = F.col("entities_extracted") if "entities_extracted" in nodes.columns else F.lit(False)
    rest = [c for c in nodes.columns if c != "entities_extracted"]
    return nodes.join(done, ["ws", "label", "name"], "left").select(*rest, F.coalesce(F.when(F.col("_done"), True), was, F.lit(False)).alias("entities_extracted"))


def is_processed(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(ws, doc_id, processed) of documents."""
    done = nodes.where("label = 'Paper' and entities_extracted").select("ws", F.col("name").alias("doc_id"), F.lit(True).alias("_p"))
    return documents.select("ws", F.col("doc_id").cast("string").alias("doc_id")).join(done, DOC, "left").select(*DOC, F.coalesce("_p", F.lit(False)).alias("processed"))


def windows(documents: DataFrame, size: int = 6000, overlap: int = 600, most: int | None = None, most_chars: int | None = None) -> DataFrame:
    """(ws, doc_id, window, text): windows of characters of the bodies, whole by default; most and most_chars cut them."""
    body = document_body(F.coalesce("title", F.lit("")), F.col("text"))
    body = F.substring(body, 1, most_chars) if most_chars else body
    return documents.select("ws", F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(char_windows(body, size, overlap, most)).alias("window", "text"))


def dictionary_model(words: DataFrame, kind: str = "Concept", relation: str = "RELATED_TO", confidence: float = 0.6) -> Callable[[DataFrame], DataFrame]:
    """A deterministic extraction model: words (word) that occur in a window are entities, and two different ones that follow one another there are related."""

    def model(wins: DataFrame) -> DataFrame:
        key = [*DOC, "window"]
        found = wins.select(*key, F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "word")).join(words.select("word").distinct(), "word")
        pairs = found.withColumn("before", F.lag("word").over(W.partitionBy(*key).orderBy("pos")))
        entity = F.struct("pos", F.struct(F.col("word").alias("name"), F.lit(kind).alias("type"), F.array().cast("array<string>").alias("aliases")).alias("e"))
        link = F.struct(F.col("before").alias("source"), F.col("word").alias("target"), F.lit(relation).alias("type"), F.concat_ws(" ", "before", "word").alias("context"), F.lit(confidence).alias("confidence"))
        one = F.when(F.col("before") != F.col("word"), F.struct("pos", link.alias("r")))
        got = pairs.groupBy(*key).agg(F.array_sort(F.collect_list(entity)).alias("e"), F.array_sort(F.collect_list(one)).alias("r"))  # a window's words
        got = got.select(*key, F.transform("e", lambda x: x["e"]).cast(ENTITIES).alias("entities"), F.transform("r", lambda x: x["r"]).cast(RELATIONS).alias("relations"))
        none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
        return wins.join(got, key, "left").select(*key, "text", none("entities", ENTITIES), none("relations", RELATIONS))

    return model


def valid_entities(rows: DataFrame) -> DataFrame:
    """Entities (name, type, ...) of known types with names that aren't blank, trimmed."""
    return rows.where(F.col("type").isin(*ENTITY_TYPES) & (F.trim("name") != "")).withColumn("name", F.trim("name"))


def valid_relations(rows: DataFrame) -> DataFrame:
    """Relations (source, target, type, ...) of known types with ends that aren't blank, trimmed."""
    return rows.where(F.col("type").isin(*RELATION_TYPES) & (F.trim("source") != "") & (F.trim("target") != "")).withColumn("source", F.trim("source")).withColumn("target", F.trim("target"))


def merge_entities(found: DataFrame) -> DataFrame:
    """(ws, doc_id, pos, name, type, aliases) from entities (..., window, pos): one for each lower-cased name and type, the first one's spelling and place, aliases in order of first appearance."""
    rows = valid_entities(found).withColumn("at", F.struct("window", "pos"))
    key = [*DOC, F.lower("name").alias("_k"), "type"]
    first = rows.groupBy(*key).agg(F.min_by("name", "at").alias("name"), F.min("at").alias("pos"))
    alias = rows.select(*key, "at", F.posexplode("aliases").alias("n", "alias")).groupBy(*DOC, "_k", "type", "alias").agg(F.min(F.struct("at", "n")).alias("first"))
    alias = alias.groupBy(*DOC, "_k", "type").agg(F.array_sort(F.collect_list(F.struct("first", "alias"))).alias("l"))
    aliases = F.coalesce(F.transform("l", lambda x: x["alias"]), F.array().cast("array<string>"))
    return first.join(alias, [*DOC, "_k", "type"], "left").select(*DOC, "pos", "name", "type", aliases.alias("aliases"))


def merge_relations(found: DataFrame) -> DataFrame:
    """Relations (..., window, pos) once for each pair of lower-cased ends and type: the one of highest confidence (missing: 0), the earliest of equals."""
    rows = valid_relations(found)
    key = [*DOC, F.lower("source").alias("_s"), F.lower("target").alias("_t"), F.col("type").alias("_type")]
    row = F.struct("source", "target", "type", "context", "confidence")
    best = rows.groupBy(*key).agg(F.min_by(row, F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("d"), "window", "pos")).alias("r"))
    return best.select(*DOC, "r.*")


def extract(documents: DataFrame, model: Callable[[DataFrame], DataFrame], **cuts: int) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of documents, merged over their windows; a window on which the model failed adds nothing."""
    got = stored(model(windows(documents, **cuts)).select(*DOC, "window", "entities", "relations"), "extraction")
    entities = got.select(*DOC, "window", F.posexplode("entities").alias("pos", "e")).select(*DOC, "window", "pos", "e.*")
    relations = got.select(*DOC, "window", F.posexplode("relations").alias("pos", "r")).select(*DOC, "window", "pos", "r.*")
    return merge_entities(entities), merge_relations(relations)


def resolved_relations(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Relations whose both ends are extracted names (ws, doc_id, pos, name, type, canonical) of their document, with canonical ends and types.

    Of one name with several types the last one's type holds. Missing confidence is 0.8, the context is cut to 500 characters.
    """
    last = names.groupBy(*DOC, "name").agg(F.max_by(F.struct("canonical", "type"), F.struct("pos", "type")).alias("n"))
    end = lambda c: last.select(*DOC, F.col("name").alias(c), F.col("n.canonical").alias(f"{c}_name"), F.coalesce("n.type", F.lit("Concept")).alias(f"{c}_label"))
    got = relations.join(end("source"), [*DOC, "source"]).join(end("target"), [*DOC, "target"])
    return got.select(*DOC, "source_label", "source_name", "type", "target_label", "target_name", F.coalesce("confidence", F.lit(0.8)).alias("confidence"), F.substring(F.coalesce("context", F.lit("")), 1, 500).alias("context"))


def document_claims(documents: DataFrame, names: DataFrame, relations: DataFrame) -> DataFrame:
    """Claims of documents: authors, categories, links to entities by type, and resolved relations."""
    doc = F.col("doc_id").cast("string")
    base = documents.select("ws", "source_id", "seq", doc.alias("doc_id"), "authors", "categories")

    def claim(rows: DataFrame, src_label: Column, src: Column, rel: Column, tgt_label: Column, tgt: Column, confidence: Column, context: Column | None = None) -> DataFrame:
        parts = (src_label.alias("src_label"), src.alias("src"), rel.alias("rel"), tgt_label.alias("tgt_label"), tgt.alias("tgt"), F.col("doc_id").alias("doc"), confidence.cast("double").alias("confidence"))
        return rows.select("ws", "source_id", "seq", *parts, (F.lit("") if context is None else context).alias("context"))

    lit, paper = F.lit, F.col("doc_id")
    authors = base.withColumn("one", F.explode("authors")).where("trim(one) <> ''")
    topics = base.withColumn("one", F.explode("categories")).where("one <> ''")
    key = base.select("ws", "source_id", "seq", "doc_id")
    linked = key.join(names.where(~F.col("type").isin(*UNLINKED)).select(*DOC, "type", "canonical").distinct(), DOC)
    link = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PAPER_LINKS.items() for x in kv]), F.col("type")), F.lit("MENTIONS"))
    parts = [
        claim(authors, lit("Person"), F.col("one"), lit("AUTHORED"), lit("Paper"), paper, lit(1.0)),
        claim(topics, lit("Paper"), paper, lit("ABOUT"), lit("Topic"), F.col("one"), lit(1.0)),
        claim(linked, lit("Paper"), paper, link, F.col("type"), F.col("canonical"), lit(0.9)),
        claim(key.join(resolved_relations(relations, names), DOC), F.col("source_label"), F.col("source_name"), F.col("type"), F.col("target_label"), F.col("target_name"), F.col("confidence"), F.col("context")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_written(names: DataFrame) -> DataFrame:
    """The resolver that leaves names as they are."""
    return names.withColumn("canonical", F.col("name"))


def ingest(
    documents: DataFrame, chunks: DataFrame, claims: DataFrame, model: Callable[[DataFrame], DataFrame], resolver: Callable[[DataFrame], DataFrame] = as_written,
    embedder: Callable[[Column], Column] = hashed_embedding, force: bool = False, **cuts: int,
) -> dict[str, DataFrame]:
    """One batch of documents into the chunk and claim tables: new chunks and claims, conflicts that they open, and each document's outcome.

    Documents already held are skipped. The graph is an aggregation of the claims (`graph.build_nodes`, `graph.build_edges`), so replaying a batch changes nothing.
    """
    todo = stored(not_yet_ingested(documents, chunks, force), "ingest-documents")
    entities, relations = extract(todo, model, **cuts)
    seq = todo.select("ws", F.col("doc_id").cast("string").alias("doc_id"), "seq")
    asked = entities.join(seq, DOC).select("ws", F.struct("seq", "doc_id", "pos").alias("seq"), F.col("type").alias("kind"), "name", "doc_id", "pos", "aliases")
    names = stored(resolver(asked).select(*DOC, "pos", "name", F.col("kind").alias("type"), "canonical"), "ingest-names")
    new = stored(document_claims(todo, names, stored(relations, "ingest-relations")), "ingest-claims")
    kept = claims.join(todo.select("ws", F.col("doc_id").cast("string").alias("doc")).distinct(), ["ws", "doc"], "left_anti")
    conflicts = flag_new_conflicts(kept.select("ws", "src", "tgt", "rel", "doc"), new.select("ws", "src", "tgt", "rel", "doc"))
    done = todo.select(*DOC, F.lit(True).alias("_done"))
    outcome = documents.select(*DOC).join(done, DOC, "left").select(*DOC, F.when(F.col("_done"), "processed").otherwise("skipped").alias("outcome"))
    return {"chunks": document_chunks(todo, embedder), "claims": new, "conflicts": conflicts, "outcome": outcome, "flag": lambda edges: flag_conflicts(edges, conflicts)}
