"""Driver queries of ingestion: documents to chunks, extractions, claims and a graph, with a dictionary as the extraction model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.operators import ingest as I
from kgspark.operators.commits import commit, read_table
from kgspark.plans.registry import over_tables
from kgspark.store import shared_folder


def as_documents(d: DataFrame) -> DataFrame:
    """The documents table in the library's form: one author and one category each."""
    doc_id = F.col("doc_id").cast("string")
    return d.select(
        F.concat(F.lit("ws_"), "lang").alias("ws"), F.col("source").alias("source_id"), F.col("doc_id").alias("seq"), doc_id.alias("doc_id"), F.concat(F.lit("Document "), doc_id).alias("title"),
        "text", F.array(F.concat(F.lit("Author "), "source")).alias("authors"), F.array("lang").alias("categories"), F.concat(F.lit("doc://"), doc_id).alias("url"), F.lit("").alias("published"),
    )


def dictionary(benchmark: DataFrame) -> DataFrame:
    """Words of six letters or more of the benchmark texts."""
    return benchmark.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 6").distinct()


def held_chunks(d: DataFrame) -> DataFrame:
    """What a workspace already holds: chunks of every third document."""
    return I.document_chunks(as_documents(d).where("seq % 3 = 0"), lambda _: F.array().cast("array<float>"))


DOC_SQL = r"""
with dictionary as (
    select distinct word from (select unnest(string_split_regex(lower(text), '[^a-z]+')) as word from benchmark) where length(word) >= 6),
docs as (
    select 'ws_' || lang as ws, source as source_id, doc_id as seq, doc_id::varchar as doc_id, lang, 'doc://' || doc_id as url,
           case when coalesce(text, '') = '' then 'Document ' || doc_id else 'Document ' || doc_id || '. ' || text end as body
    from documents),
wins as (
    select ws, doc_id, i as win, case when length(body) <= 6000 then body else substr(body, i * 5400 + 1, 6000) end as text
    from (select *, unnest(range(0, case when length(body) <= 6000 then 1 else ceil(length(body) / 5400.0)::bigint end)) as i from docs)),
tokens as (
    select ws, doc_id, win, unnest(w) as word, unnest(range(len(w))) as pos from (select ws, doc_id, win, string_split_regex(lower(text), '[^a-z]+') as w from wins)),
found as (select tokens.* from tokens join dictionary using (word)),
entities as (select distinct ws, doc_id, word as name from found),
relations as (
    select distinct ws, doc_id, before as source, word as target
    from (select *, lag(word) over (partition by ws, doc_id, win order by pos) as before from found) where before <> word),
words as (select *, list_filter(string_split_regex(body, '\s+'), lambda x: x <> '') as w from docs),
parts as (select ws, source_id, seq, doc_id, url, unnest(range(0, greatest(0, ceil((len(w) - 400) / 360.0)::bigint) + 1)) as i from words)
"""
CLAIM_SQL = (
    DOC_SQL
    + """, claims as (
    select ws, source_id, seq, 'Person' as src_label, 'Author ' || source_id as src, 'AUTHORED' as rel, 'Paper' as tgt_label, doc_id as tgt, doc_id as doc, 1.0::double as confidence from docs
    union all select ws, source_id, seq, 'Paper', doc_id, 'ABOUT', 'Topic', lang, doc_id, 1.0 from docs
    union all select ws, source_id, seq, 'Paper', doc_id, 'MENTIONS', 'Concept', name, doc_id, 0.9 from docs join entities using (ws, doc_id)
    union all select ws, source_id, seq, 'Concept', source, 'RELATED_TO', 'Concept', target, doc_id, 0.6 from docs join relations using (ws, doc_id))
"""
)


@over_tables("vec_7_entities", "documents benchmark", DOC_SQL + "select ws, doc_id, name, 'Concept' as type from entities")
def vec_7(d: DataFrame, b: DataFrame) -> DataFrame:
    return I.extract(as_documents(d), I.dictionary_model(dictionary(b)))[0].select("ws", "doc_id", "name", "type")


@over_tables("agg_7_relations", "documents benchmark", DOC_SQL + "select ws, doc_id, source, target, 'RELATED_TO' as type, source || ' ' || target as context, 0.6::double as confidence from relations")
def agg_7(d: DataFrame, b: DataFrame) -> DataFrame:
    return I.extract(as_documents(d), I.dictionary_model(dictionary(b)))[1]


@over_tables("join_14_resolved", "documents benchmark", DOC_SQL + "select ws, doc_id, 'Concept' as source_label, upper(source) as source_name, 'Concept' as target_label, upper(target) as target_name from relations")
def join_14(d: DataFrame, b: DataFrame) -> DataFrame:
    entities, relations = I.extract(as_documents(d), I.dictionary_model(dictionary(b)))
    return I.resolved_relations(relations, entities.withColumn("canonical", F.upper("name"))).select("ws", "doc_id", "source_label", "source_name", "target_label", "target_name")


@over_tables("join_15_claims", "documents benchmark", CLAIM_SQL + "select ws, source_id, seq, src_label, src, rel, tgt_label, tgt, doc, confidence from claims")
def join_15(d: DataFrame, b: DataFrame) -> DataFrame:
    docs = as_documents(d)
    entities, relations = I.extract(docs, I.dictionary_model(dictionary(b)))
    return I.document_claims(docs, I.as_written(entities), relations).drop("context")


@over_tables("fil_5_not_yet_ingested", "documents", "select 'ws_' || lang as ws, doc_id::varchar as doc_id from documents where doc_id % 3 <> 0")
def fil_5(d: DataFrame) -> DataFrame:
    return I.not_yet_ingested(as_documents(d), held_chunks(d)).select("ws", "doc_id")


CHUNK_SQL = (
    DOC_SQL.replace("from benchmark", "from (select '' as text)")
    + "select ws, url as chunk_source, ws || ':' || url || ':' || i as chunk_id, i::int as chunk_index, source_id from parts"
)


@over_tables("sink_4_chunks", "documents", CHUNK_SQL)
def sink_4(d: DataFrame) -> DataFrame:
    """All documents ingested over a table that holds chunks of every third one, and stale ones of theirs."""
    old = held_chunks(d)
    stale = old.withColumn("chunk_id", F.concat("chunk_id", F.lit(":stale")))
    new = I.document_chunks(as_documents(d), lambda _: F.array().cast("array<float>"))
    return I.upsert_chunks(old.unionByName(stale), new).select("ws", "chunk_source", "chunk_id", "chunk_index", "source_id")


@over_tables("sink_4_table", "documents", CHUNK_SQL)
def sink_4_table(d: DataFrame) -> DataFrame:
    """The same as a table that two batches wrote: stale chunks of every third document, then all documents; the second batch is replayed."""
    spark, at = d.sparkSession, shared_folder(d.sparkSession, "chunks")
    held = held_chunks(d)
    new = I.document_chunks(as_documents(d), lambda _: F.array().cast("array<float>"))
    commit(spark, at, "held", {"chunks": held.unionByName(held.withColumn("chunk_id", F.concat("chunk_id", F.lit(":stale"))))})
    for _ in range(2):
        commit(spark, at, "all", {"chunks": new})
    return read_table(spark, at, "chunks").select("ws", "chunk_source", "chunk_id", "chunk_index", "source_id")


@over_tables("sink_5_processed", "documents", "select 'ws_' || lang as ws, doc_id::varchar as doc_id, doc_id % 3 = 0 as processed from documents")
def sink_5(d: DataFrame) -> DataFrame:
    docs = as_documents(d)
    nodes = docs.select("ws", F.lit("Paper").alias("label"), F.col("doc_id").alias("name"))
    return I.is_processed(I.mark_processed(nodes, docs.where("seq % 3 = 0")), docs)


@over_tables(
    "vec_12_ingest",
    "documents benchmark",
    CLAIM_SQL
    + """, new as (select * from claims where seq % 3 <> 0),
    ends as (select ws, src_label as label, src as name from new union select ws, tgt_label, tgt from new),
    c as (select ws, count(*) as chunks from parts where seq % 3 <> 0 group by ws),
    n as (select ws, count(*) as nodes from ends group by ws),
    e as (select ws, count(distinct (src_label, src, rel, tgt_label, tgt)) as edges, count(*) as claims from new group by ws)
    select docs.ws, count(*) filter (seq % 3 <> 0) as processed, count(*) filter (seq % 3 = 0) as skipped, any_value(chunks) as chunks, any_value(claims) as claims, any_value(nodes) as nodes, any_value(edges) as edges
    from docs left join c using (ws) left join n using (ws) left join e using (ws) group by docs.ws""",
)
def vec_12(d: DataFrame, b: DataFrame) -> DataFrame:
    """The whole batch flow over a table that holds every third document already: outcomes and what was added, per workspace."""
    docs, held = as_documents(d), held_chunks(d)
    none = d.sparkSession.createDataFrame([], "ws string, src string, tgt string, rel string, doc string")
    got = I.ingest(docs, held, none, I.dictionary_model(dictionary(b)))
    count = lambda df, name: df.groupBy("ws").agg(F.count(F.lit(1)).alias(name))
    done = got["outcome"].groupBy("ws").agg(F.count_if(F.col("outcome") == "processed").alias("processed"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    nodes = G.ends(got["claims"]).select("ws", "label", "name").distinct()
    edges = got["claims"].select("ws", *G.EDGE[1:]).distinct()
    for part in (count(got["chunks"], "chunks"), count(got["claims"], "claims"), count(nodes, "nodes"), count(edges, "edges")):
        done = done.join(part, "ws", "left")
    return done
