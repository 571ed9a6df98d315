"""Driver queries of answers, evidence and figures, over conversations, labels, events, customers and the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions import text as T
from kgspark.operators import answers as A
from kgspark.operators import graph as G
from kgspark.operators import patterns as P
from kgspark.operators import retrieval as R
from kgspark.plans.registry import over_graph, over_tables
from kgspark.store import stored


@over_graph(
    "fil_2_graph_edges",
    "select ws, src as source, tgt as target, src_label as source_type, tgt_label as target_type, rel as relation_type, coalesce(confidence, 1.0) as confidence from edges where not (src_label = 'Person' and src like '%4') and not (tgt_label = 'Person' and tgt like '%4')",
)
def fil_2(c: DataFrame) -> DataFrame:
    """Persons whose names end in 4 are stubs."""
    edges = stored(G.build_edges(c).select(*G.EDGE, "confidence"), "edges")
    nodes = stored(G.node_keys(edges).withColumn("is_stub", (F.col("label") == "Person") & F.col("name").endswith("4")), "node-keys")
    return A.graph_edges(edges, nodes)


@over_tables("fil_10_slugs", "pages", "select page_id, array_to_string(list_slice(list_filter(string_split(url, '/'), lambda x: contains(x, '.') and length(x) between 3 and 20), 1, 4), ',') as slugs from pages")
def fil_10(p: DataFrame) -> DataFrame:
    return p.select("page_id", F.array_join(A.category_slugs(F.split("url", "/")), ",").alias("slugs"))


@over_graph("fil_11_predicted", "select case when rel in ('AUTHORED', 'CITED', 'SUPPORTS', 'CONTRADICTS') then rel else 'SUPPORTS' end as relation, count(*) as n from edges group by all")
def fil_11(c: DataFrame) -> DataFrame:
    return G.edge_keys(c).groupBy(A.relation_of(F.col("rel")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@over_tables("fil_11_routes", "events", "select case when lower(event_type) in ('graph', 'vector', 'hybrid') then event_type else 'hybrid' end as route, count(*) as n from events group by all")
def fil_11_routes(e: DataFrame) -> DataFrame:
    return e.groupBy(A.route_of(F.col("event_type")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


_PAIRS = ", f as (select e.* from edges e where rel in ('SUPPORTS', 'CONTRADICTS') and (ws, src, tgt) in (select (s.ws, s.src, s.tgt) from claims s join claims r on s.ws = r.ws and s.src = r.src and s.tgt = r.tgt and s.doc <> r.doc where s.rel = 'SUPPORTS' and r.rel = 'CONTRADICTS'))"


@over_graph(
    "join_10_conflicts_for",
    _PAIRS
    + """, asked as (select distinct ws, src from f qualify dense_rank() over (partition by ws order by src) <= 20),
    g as (select ws, src as source, tgt as target, string_agg(distinct rel, ',' order by rel) as claim_types, string_agg(distinct doc, ',' order by doc) as documents from f where (ws, src) in (select (ws, src) from asked) group by all)
    select ws as qid, ws, source, target, claim_types, documents from g qualify row_number() over (partition by ws order by source, target) <= 25""",
)
def join_10(c: DataFrame) -> DataFrame:
    """Each workspace asks for the names that dispute anything; the operator takes the first twenty."""
    edges = P.flag_conflicts(G.build_edges(c), P.detect_conflicts(c))
    names = A.first_names(edges.where("conflict_flag").select(F.col("ws").alias("qid"), "ws", F.col("src").alias("name")))
    return P.conflicts_for(edges, names)


_CLAIM_SETS = """, k as (select distinct s.ws, s.src, s.tgt from claims s join claims r on s.ws = r.ws and s.src = r.src and s.tgt = r.tgt and s.doc <> r.doc where s.rel = 'SUPPORTS' and r.rel = 'CONTRADICTS'),
    cl as (select c.ws, c.src as source, c.tgt as target, string_agg(distinct rel, ',' order by rel) as claim_types, string_agg(distinct doc, ',' order by doc) as documents
          from claims c join k on c.ws = k.ws and c.src = k.src and c.tgt = k.tgt where rel in ('SUPPORTS', 'CONTRADICTS') group by all)"""


@over_graph("join_11_conflicts", _CLAIM_SETS + " select * from cl")
def join_11(c: DataFrame) -> DataFrame:
    return P.list_conflicts(c)


@over_graph("join_11_conflicts_of", _CLAIM_SETS + " select ws, target as source, source as target, claim_types, documents from cl where target like 'supplier-%'")
def join_11_of(c: DataFrame) -> DataFrame:
    """Conflicts of all organisations, asked for in capitals."""
    return P.list_conflicts(c, G.build_nodes(c).where("label = 'Organization'").select("ws", F.upper("name").alias("name")))


_SOURCES = """with last as (select user_id, arg_max(event_type, {'t': ts, 'e': event_id}) as kind from events group by user_id),
    s as (select 'ws_' || (user_id % 5) as ws, case kind when 'signup' then 'pending' when 'purchase' then 'success' when 'error' then 'error' when 'view' then 'running' else 'success' end as status,
                 ['arxiv_feed', 'rss', 'web_url', 'pdf_upload'][user_id % 4 + 1] as type from last)"""


def sources_of(e: DataFrame) -> DataFrame:
    """A source for each user, in the state of its last event."""
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    status = F.when(F.col("kind") == "signup", "pending").when(F.col("kind") == "error", "error").when(F.col("kind") == "view", "running").otherwise("success")
    kinds = F.array(*map(F.lit, ("arxiv_feed", "rss", "web_url", "pdf_upload")))
    return last.select(F.concat(F.lit("ws_"), (F.col("user_id") % 5).cast("string")).alias("ws"), status.alias("status"), F.get(kinds, (F.col("user_id") % 4).cast("int")).alias("type"))


@over_tables(
    "agg_8_source_stats",
    "events",
    _SOURCES
    + """ select ws, count(*) as total, count(*) filter (status = 'success') as ready, count(*) filter (status in ('pending', 'running')) as active, count(*) filter (status = 'error') as error,
    count(*) filter (type = 'arxiv_feed') as arxiv, count(*) filter (type = 'rss') as rss, count(*) filter (type = 'web_url') as web, count(*) filter (type = 'pdf_upload') as pdf,
    case when count(*) filter (status <> 'success') > 0 then round(count(*) filter (status = 'success') / count(*) * 100)::bigint else 100 end as readiness from s group by ws""",
)
def agg_8(e: DataFrame) -> DataFrame:
    return A.source_stats(sources_of(e))


@over_tables(
    "agg_12_evidence",
    "conversations",
    """with p as (select conv_id as qid, turn as n, role, text, role as source, substr(text, 1, 1) as target from conversations),
    c as (select qid, source, target, min(n) as n from p where text is not null group by all),
    s as (select qid, count(*) filter (role = 'user') as n_records, count(*) filter (role <> 'user') as n_passages from p group by qid)
    select s.qid, any_value(n_records) as n_records, any_value(n_passages) as n_passages, coalesce(string_agg(c.source || '>' || c.target, ',' order by c.n), '') as conflicts from s left join c using (qid) group by s.qid""",
)
def agg_12(c: DataFrame) -> DataFrame:
    """Each turn is a sub-answer: users' texts are its records, others' its passages."""
    own = lambda keep: F.when(keep, F.array(F.coalesce("text", F.lit("")))).otherwise(F.array().cast("array<string>"))
    pairs = F.when(F.col("text").isNotNull(), F.array(F.struct(F.col("role").alias("source"), F.substring("text", 1, 1).alias("target")))).otherwise(F.array().cast("array<struct<source: string, target: string>>"))
    parts = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("n"), own(F.col("role") == "user").alias("records"), own(F.col("role") != "user").alias("passages"), pairs.alias("conflicts"))
    got = A.union_evidence(parts)
    joined = F.array_join(F.transform("conflicts", lambda x: F.concat(x["source"], F.lit(">"), x["target"])), ",")
    return got.select("qid", "n_records", "n_passages", F.coalesce(joined, F.lit("")).alias("conflicts"))


@over_tables("agg_15_accuracy", "labels", "select coalesce(avg((quality = 1 - toxic)::int), 0)::double as accuracy from labels")
def agg_15(x: DataFrame) -> DataFrame:
    return A.mean_of(x, F.col("quality") == 1 - F.col("toxic"), "accuracy")


_DIGITS = lambda c: " + ".join(f"(('0x' || substr(sha256(lower(trim({c}))), {i * 8 + 1}, 8))::bigint % 7) * {pow(pow(2, 32, 7), 7 - i, 7)}" for i in range(8))


@over_graph("agg_19_cut", f" select round(avg((({_DIGITS('src')}) % 7 <> ({_DIGITS('tgt')}) % 7)::int), 9) as cut from edges")
def agg_19(c: DataFrame) -> DataFrame:
    return A.cut_fraction(G.edge_keys(c), 7).select(F.round("cut", 9).alias("cut"))


@over_tables("agg_20_threads", "conversations", "select conv_id, count(*) as turns, arg_max(role, turn) as last_type from conversations group by conv_id")
def agg_20(c: DataFrame) -> DataFrame:
    return A.thread_summary(c.select("conv_id", F.col("turn").alias("turn_index"), F.col("role").alias("retrieval_type"), F.col("conv_id").alias("created_at")))


@over_graph("agg_21_profile", ", x as (select ws, src as e from edges union select ws, tgt from edges) select edges.ws as qid, count(distinct rel) as rel_types, (select count(*) from x where x.ws = edges.ws) as entities, count(distinct (src, rel, tgt)) as paths from edges group by edges.ws")
def agg_21(c: DataFrame) -> DataFrame:
    return A.record_profile(G.edge_keys(c).select(F.col("ws").alias("qid"), F.col("src").alias("from"), "rel", F.col("tgt").alias("to")))


@over_tables("fn_5_embed_text", "customer", "select c_custkey, trim(c_name) || ' | type: ' || c_mktsegment || ' | aka ' || c_custkey || ', ' || c_nationkey as text from customer")
def fn_5(c: DataFrame) -> DataFrame:
    return c.select("c_custkey", A.embed_text(F.col("c_name"), F.col("c_mktsegment"), F.array(F.col("c_custkey").cast("string"), F.lit(""), F.col("c_nationkey").cast("string"))).alias("text"))


@over_tables(
    "fn_12_key_entities",
    "conversations",
    """with r as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) as k from conversations where coalesce(text, '') <> '' and coalesce(role, '') <> '')
    select conv_id, string_agg(substr(text, 1, 100) || '|' || role || '|' || substr(text, 1, 200), ';' order by turn) as entities from r where k <= 6 group by conv_id""",
)
def fn_12(c: DataFrame) -> DataFrame:
    """Each conversation's turns as a model's JSON list of entities."""
    row = F.struct("turn", F.struct(F.col("text").alias("name"), F.col("role").alias("type"), F.col("text").alias("role")).alias("e"))
    raw = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["e"])).alias("raw"))
    got = F.transform(A.key_entities(F.col("raw")), lambda e: F.concat_ws("|", e["name"], e["type"], e["role"]))
    return raw.select("conv_id", F.array_join(got, ";").alias("entities"))


@over_tables(
    "fn_13_insights",
    "conversations",
    """with r as (select conv_id, count(*) as n, min(turn) as lo from conversations group by conv_id)
    select conv_id, case when n >= 2 then '{"type":"flow_path","title":"t","steps":[' ||
        array_to_string(list_transform(range(1, least(n, 10) + 1), lambda i: '{"entity":"e' || i || '","entity_type":"Concept"}'), ',') || ']}' else '' end as insights from r""",
)
def fn_13(c: DataFrame) -> DataFrame:
    """A flow of as many steps as a conversation has turns, among charts of unknown kind and without content."""
    steps = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(F.concat(F.lit("e"), i.cast("string")).alias("entity")))
    raw = F.to_json(F.struct(F.lit("flow_path").alias("type"), F.lit("t").alias("title"), steps.alias("steps")))
    listed = F.concat(F.lit('[{"type":"pie"},{"type":"bar_chart","data":[]},'), raw, F.lit(',7]'))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", F.array_join(A.insights(listed), ";").alias("insights"))


@over_tables("top_4_latest", "events", "select event_id, user_id, event_type from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 50")
def top_4(e: DataFrame) -> DataFrame:
    return R.latest(e, "ts", 50, "event_type", "event_id").select("event_id", "user_id", "event_type")


_TURNS = "with t as (select conv_id, turn, role, coalesce(text, '') as text, first_value(coalesce(text, '')) over (partition by conv_id order by turn) as q from conversations)"
_WORDSET = "list_distinct(list_filter(string_split_regex(lower({0}), '\\W+'), lambda w: w <> ''))"


@over_tables(
    "vec_3_reranked",
    "conversations",
    _TURNS
    + f""", w as (select *, {_WORDSET.format('q')} as a, {_WORDSET.format('text')} as b, count(*) over (partition by conv_id) as n from t),
    s as (select conv_id as qid, turn as id, turn as was, case when n <= 1 then null when len(a) = 0 then 0.0 else len(list_intersect(a, b)) / len(a) end as score from w)
    select qid, id, round(score, 9) as rerank_score, row_number() over (partition by qid order by score desc nulls last, was)::bigint as rank from s qualify rank <= 3""",
)
def vec_3(c: DataFrame) -> DataFrame:
    """A conversation's turns as hits of its first one, scored by the words they share."""
    q = F.first_value(F.coalesce("text", F.lit(""))).over(W.partitionBy("conv_id").orderBy("turn"))
    hits = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("text"), q.alias("q"))
    got = R.rerank(hits, R.token_overlap(F.col("q"), F.col("text")), 3)
    return got.select("qid", "id", F.round("rerank_score", 9).alias("rerank_score"), F.col("rank").cast("long").alias("rank"))


@over_tables(
    "vec_9_judged",
    "conversations",
    r"""with t as (select conv_id * 1000 + turn as qid, coalesce(text, '') as answer, coalesce(lag(text) over (partition by conv_id order by turn), '') as evidence from conversations),
    s as (select qid, evidence, list_filter(list_transform(string_split_regex(answer, '[.!?]+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') as parts from t),
    u as (select qid, evidence, unnest(parts) as claim, unnest(range(len(parts))) as place from s)
    select qid, place::int as place, substr(claim, 1, 300) as claim,
           len(list_filter(string_split_regex(lower(claim), '[^a-z0-9]+'), lambda w: w <> '' and not list_contains(string_split_regex(lower(evidence), '[^a-z0-9]+'), w))) = 0 as supported from u""",
)
def vec_9(c: DataFrame) -> DataFrame:
    """Each turn as an answer, with the one before as its evidence."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return A.judged_claims(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("answer"), F.coalesce(before, F.lit("")).alias("evidence")))


@over_tables("vec_11_payload", "conversations", "select conv_id as qid, count(*) filter (role = 'user') as n_graph_records, 0::bigint as n_entity_degree_context, 0::bigint as n_conflicts, 0::bigint as n_entity_influence, count(*) filter (role = 'assistant') as n_vector_passages from conversations group by conv_id")
def vec_11(c: DataFrame) -> DataFrame:
    part = lambda role: c.where(F.col("role") == role).select(F.col("conv_id").alias("qid"), F.col("turn").alias("place"), "text")
    none = part("nobody")
    got = A.retrieval_payload(c.select(F.col("conv_id").alias("qid")).distinct(), part("user"), none, none, none, part("assistant"))
    return got.drop("payload")


@over_tables(
    "vec_13_export",
    "conversations",
    """with r as (select conv_id, count(*) as total, count(*) filter (role = 'user') as supported, arg_min(coalesce(text, ''), turn) as question, arg_max(coalesce(text, ''), turn) as answer, list({'r': role, 't': coalesce(text, '')} order by turn) as p from conversations group by conv_id)
    select conv_id as report_id, '# ' || question || chr(10) || chr(10) || answer || chr(10) || chr(10) || '## Retrieval' || chr(10) || chr(10) || '- Route: graph' || chr(10) || '- Version: 1' || chr(10) || '- Graph records: ' || total || chr(10)
        || '- Passages: ' || len(p) || chr(10) || '- Conflicts: 0' || chr(10) || '- Trust score: ' || round(supported / total * 100)::bigint || '% (' || supported || '/' || total || ' claims)' || chr(10) || chr(10) || '## Passages' || chr(10)
        || array_to_string(list_transform(p, lambda x, i: chr(10) || i || '. ' || coalesce(x.r, 'Untitled source') || chr(10) || '' || chr(10) || '   ' || x.t), chr(10)) as markdown from r""",
)
def vec_13(c: DataFrame) -> DataFrame:
    """Each conversation as a report whose passages are its turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.struct(F.col("role").alias("title"), F.lit("").alias("url"), F.coalesce("text", F.lit("")).alias("text")).alias("p"))))
    r = c.groupBy("conv_id").agg(turns.alias("t"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("role") == "user").alias("supported"))
    return A.markdown_report(r.select(
        F.col("conv_id").alias("report_id"), F.get("t", F.lit(0))["p"]["text"].alias("question"), F.element_at("t", -1)["p"]["text"].alias("answer"), F.lit("graph").alias("route"), F.lit(1).alias("version"),
        F.col("total").alias("n_records"), F.lit(0).alias("n_conflicts"), "supported", "total", F.lit("").alias("query"), F.transform("t", lambda x: x["p"]).alias("passages"),
    ))


@over_tables(
    "fn_10_job_ids",
    "customer",
    """with h as (select c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_mktsegment || ':' || c_name)) as h from customer)
    select c_custkey, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), '5' || substr(h, 14, 3), substr('89ab', ('0x' || substr(h, 17, 1))::int % 4 + 1, 1) || substr(h, 18, 3), substr(h, 21, 12)) as job_id from h""",
)
def fn_10(c: DataFrame) -> DataFrame:
    """Name-based UUIDs; the unit test compares them with Python's too."""
    return c.select("c_custkey", T.job_id(F.col("c_mktsegment"), F.col("c_name")).alias("job_id"))


@over_tables("fn_16_rewrites", "conversations", "with r as (select conv_id, turn, coalesce(text, '') as q, trim(coalesce(lag(text) over (partition by conv_id order by turn), '')) as w from conversations), g as (select *, case when w = '' or length(w) > 400 then q else w end as rewrite from r) select conv_id, turn, rewrite, lower(trim(rewrite)) <> lower(trim(q)) as rewritten from g")
def fn_16(c: DataFrame) -> DataFrame:
    """Each turn with the one before as its rewrite."""
    rows = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("q"), F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")).alias("w"))
    return rows.select("conv_id", "turn", T.guarded_rewrite(F.col("q"), F.col("w")).alias("rewrite"), T.is_rewritten(F.col("q"), F.col("w")).alias("rewritten"))


@over_tables("fn_19_findings", "conversations", "select conv_id as qid, string_agg('### Sub-question ' || (turn + 1) || ' (' || role || '): q' || turn || chr(10) || case when coalesce(text, '') = '' then '(no findings)' else text end, chr(10) || chr(10) order by turn) as findings from conversations group by conv_id")
def fn_19(c: DataFrame) -> DataFrame:
    from kgspark.operators.evidence import findings_text

    return findings_text(c.select(F.col("conv_id").alias("qid"), (F.col("turn") + 1).alias("n"), F.concat(F.lit("q"), F.col("turn").cast("string")).alias("question"), F.col("role").alias("route"), F.col("text").alias("answer")))
