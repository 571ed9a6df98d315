"""Driver queries of graph building, counting and pattern matching over the derived property graph, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.operators import patterns as P
from kgspark.operators.commits import commit_claims, read_table
from kgspark.operators.trails import trail_counts
from kgspark.plans.registry import over_graph
from kgspark.store import forget, shared_folder, stored

_SYM = ", sym as (select ws, src as a, tgt as b, rel from edges union all select ws, tgt, src, rel from edges)"
_CONFLICTS = """, k as (
    select s.ws, s.src, s.tgt, count(*)::bigint as matches
    from claims s join claims r on s.ws = r.ws and s.src = r.src and s.tgt = r.tgt and s.doc <> r.doc
    where s.rel = 'SUPPORTS' and r.rel = 'CONTRADICTS' group by all)"""


def edges_of(c: DataFrame, *rels: str) -> DataFrame:
    return G.build_edges(c.where(F.col("rel").isin(*rels)) if rels else c)


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("source_ids", F.array_join("source_ids", ","))


def counted(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@over_graph("sink_1_nodes", "select * from nodes")
def sink_1(c: DataFrame) -> DataFrame:
    return flat(G.build_nodes(c))


@over_graph(
    "sink_1_first_writer",
    """, e as (select ws, src_label as label, src as name, seq, doc from claims union all select ws, tgt_label, tgt, seq, doc from claims)
    select ws, label, name, arg_min(doc, {'s': seq, 'd': doc}) as doc from e group by all""",
)
def sink_1_first(c: DataFrame) -> DataFrame:
    """The document that first named each node, as its property."""
    two = F.array(F.struct(F.col("src_label").alias("label"), F.col("src").alias("name")), F.struct(F.col("tgt_label").alias("label"), F.col("tgt").alias("name")))
    rows = c.select("ws", "seq", "doc", F.explode(two).alias("e")).select("ws", "e.label", "e.name", "seq", "doc")
    return G.upsert_first(rows, ["ws", "label", "name"], ["doc"], "seq")


@over_graph("sink_3_edges", "select * from edges")
def sink_3(c: DataFrame) -> DataFrame:
    return flat(G.build_edges(c))


def committed(c: DataFrame, name: str) -> DataFrame:
    """A table of the graph that two batches wrote: the claims of all sources but one, then that one's."""
    spark, at, c = c.sparkSession, shared_folder(c.sparkSession, "graph"), stored(c, "claims")
    late = F.col("source_id") == "src_3"
    commit_claims(spark, at, "first", c.where("false"), c.where(~late))
    commit_claims(spark, at, "late", c.where(~late), c.where(late))
    forget(c)
    return read_table(spark, at, name)


@over_graph("sink_7_nodes", "select * from nodes")
def sink_7_nodes(c: DataFrame) -> DataFrame:
    return flat(committed(c, "nodes"))


@over_graph("sink_7_edges", "select * from edges")
def sink_7_edges(c: DataFrame) -> DataFrame:
    return flat(committed(c, "edges"))


@over_graph("sink_3_checked_ends", "select ws, rel, count(*) as n from edges where not (src_label = 'Concept' and src like '%1') and not (tgt_label = 'Concept' and tgt like '%1') group by all")
def sink_3_checked(c: DataFrame) -> DataFrame:
    """Concepts whose names end in 1 are no nodes: edges at them are dropped."""
    keys = stored(G.edge_keys(c), "edge-keys")
    nodes = G.node_keys(keys).where(~((F.col("label") == "Concept") & F.col("name").endswith("1")))
    return counted(G.with_ends(keys, stored(nodes, "node-keys")), "ws", "rel")


@over_graph("sink_2_last_writer", "select ws, src, arg_max(doc, seq) as doc from claims where rel = 'AUTHORED' and src_label = 'Person' group by all")
def sink_2(c: DataFrame) -> DataFrame:
    return G.upsert_last(c.where("rel = 'AUTHORED' and src_label = 'Person'"), ["ws", "src"], "doc", "seq")


@over_graph("agg_1_counts", "select ws, label, count(*) as n from nodes group by all")
def agg_1_nodes(c: DataFrame) -> DataFrame:
    return counted(G.build_nodes(c), "ws", "label")


@over_graph("agg_1_edge_mix", "select ws, rel, count(*) as n from edges group by all")
def agg_1_edges(c: DataFrame) -> DataFrame:
    return counted(G.edge_keys(c), "ws", "rel")


@over_graph(
    "agg_2_collapsed",
    """select ws, src as s, tgt as t, round(sum(coalesce(nullif(confidence, 0), 1)), 6) as w
    from edges where src <> tgt and trim(src) <> '' and trim(tgt) <> '' group by all""",
)
def agg_2(c: DataFrame) -> DataFrame:
    return G.weighted_edges(edges_of(c)).withColumn("w", F.round("w", 6))


@over_graph("agg_3_node_types", "select ws, name, min(label) as label from nodes group by all")
def agg_3(c: DataFrame) -> DataFrame:
    return G.node_types(G.build_nodes(c))


@over_graph("agg_4_degrees", _SYM + " select ws, a as name, count(*) as degree from sym group by all")
def agg_4(c: DataFrame) -> DataFrame:
    return G.degrees(G.edge_keys(c))


@over_graph(
    "agg_5_most_cited",
    """, n as (select ws, tgt as name, count(*) as n from edges where rel = 'CITED' group by all)
    select ws, name, n, row_number() over (partition by ws order by n desc, name)::bigint as rank from n qualify rank <= 10""",
)
def agg_5(c: DataFrame) -> DataFrame:
    return G.top_per_workspace(G.in_degrees(edges_of(c, "CITED"), "CITED"), "n", 10).withColumn("rank", F.col("rank").cast("long"))


@over_graph("agg_6_prolific_authors", "select ws, src as name, count(*) as n from edges where rel = 'AUTHORED' and src_label = 'Person' group by all")
def agg_6(c: DataFrame) -> DataFrame:
    return G.out_degrees(edges_of(c, "AUTHORED"), "AUTHORED", "Person")


@over_graph("fil_1_workspace_scope", "select rel, count(*) as n from edges where ws = 'ws_building' group by all")
def fil_1(c: DataFrame) -> DataFrame:
    return counted(edges_of(G.in_workspace(c, "ws_building")), "rel")


@over_graph("fil_3_weights", "select rel, round(sum(coalesce(nullif(confidence, 0), 1)), 4) as w from edges group by all")
def fil_3(c: DataFrame) -> DataFrame:
    return edges_of(c).groupBy("rel").agg(F.round(F.sum(G.weight_of(F.col("confidence"))), 4).alias("w"))


@over_graph("join_1_match_edges", "select ws, src, rel, tgt from edges where rel in ('SUPPORTS', 'CONTRADICTS') and src_label = 'Concept' and tgt_label = 'Organization'")
def join_1(c: DataFrame) -> DataFrame:
    return P.match_edges(edges_of(c, "SUPPORTS", "CONTRADICTS"), ["SUPPORTS", "CONTRADICTS"], "Concept", "Organization")


@over_graph(
    "join_2_optional_match",
    """select n.ws, n.label, n.name, e.tgt as neighbor
    from nodes n left join edges e on e.ws = n.ws and e.src_label = n.label and e.src = n.name and e.rel = 'CITED' where n.label = 'Paper'""",
)
def join_2(c: DataFrame) -> DataFrame:
    return P.optional_match(G.build_nodes(c).where("label = 'Paper'"), edges_of(c), "CITED")


@over_graph("join_3_undirected", _SYM + " select ws, rel, count(*) as n, count(distinct a) as nodes from sym group by all")
def join_3(c: DataFrame) -> DataFrame:
    return G.both_ways(G.edge_keys(c)).groupBy("ws", "rel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("a").alias("nodes"))


@over_graph(
    "join_4_q3_shared_author",
    """, one as (select distinct ws, src as mid, tgt as n from edges where rel = 'AUTHORED')
    select x.ws, x.n as a, y.n as c, count(*) as shared from one x join one y on x.ws = y.ws and x.mid = y.mid and x.n < y.n group by all""",
)
def join_4(c: DataFrame) -> DataFrame:
    return P.two_hop(edges_of(c, "AUTHORED"), "AUTHORED")


@over_graph(
    "join_5_q1_open_triangles",
    """, one as (select distinct ws, tgt as mid, src as n from edges where rel = 'AUTHORED'),
    d as (select distinct x.ws, x.n as a, y.n as c from one x join one y on x.ws = y.ws and x.mid = y.mid and x.n <> y.n)
    select distinct x.ws, x.a, y.c from d x join d y on x.ws = y.ws and x.c = y.a and x.a < y.c
    where not exists (select 1 from d z where z.ws = x.ws and z.a = x.a and z.c = y.c)""",
)
def join_5(c: DataFrame) -> DataFrame:
    return P.open_triangles(edges_of(c, "AUTHORED"), "AUTHORED")


@over_graph(
    "join_6_q5_cited_paths",
    """, e as (select ws, src, tgt from edges where rel = 'CITED'),
    w as (
        select ws, src as s, tgt as t, 1 as h, [src || '>' || tgt] as u from e
        union all
        select w.ws, w.s, e.tgt, h + 1, list_append(u, e.src || '>' || e.tgt) from w join e on e.ws = w.ws and e.src = w.t where h < 5 and not list_contains(u, e.src || '>' || e.tgt))
    select ws, h::bigint as hops, count(*) as n, count(distinct s) as starts from w group by all""",
    recursive=True,
)
def join_6(c: DataFrame) -> DataFrame:
    return P.paths(edges_of(c, "CITED"), ["CITED"], 5).groupBy("ws", "hops").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("start").alias("starts"))


@over_graph(
    "join_6_q2_chains",
    """, e as (select ws, src, tgt, src_label, tgt_label, rel || ':' || src || '>' || tgt as id from edges where rel in ('AUTHORED', 'AFFILIATED_WITH')),
    b as (select ws, src as s, tgt as t, tgt_label as l, src_label as f, id from e union all select ws, tgt, src, src_label, tgt_label, id from e),
    w as (
        select ws, s, t, l, 1 as h, [id] as u from b where f = 'Person'
        union all
        select w.ws, w.s, b.t, b.l, h + 1, list_append(u, b.id) from w join b on b.ws = w.ws and b.s = w.t where h < 4 and not list_contains(u, b.id))
    select ws, s as start, h::bigint as hops, count(*) as n, count(distinct t) as ends from w where l = 'Person' group by all""",
    recursive=True,
)
def join_6_q2(c: DataFrame) -> DataFrame:
    """Persons that are joined by up to four edges over papers and organisations, in any direction."""
    rels = ["AUTHORED", "AFFILIATED_WITH"]
    return trail_counts(G.edge_keys(c.where(F.col("rel").isin(rels))), rels, 4, directed=False, start_label="Person", end_label="Person")


@over_graph("join_7_q4_disputed", "select distinct ws, tgt as name from edges where rel = 'SUPPORTS' and (ws, tgt) in (select (ws, tgt) from edges where rel = 'CONTRADICTS')")
def join_7(c: DataFrame) -> DataFrame:
    return P.disputed_targets(edges_of(c, "SUPPORTS", "CONTRADICTS"))


@over_graph("join_8_conflicts", _CONFLICTS + " select * from k")
def join_8(c: DataFrame) -> DataFrame:
    return P.detect_conflicts(c)


@over_graph("join_8_flags", _CONFLICTS + " select rel, count(*) as n from edges join k using (ws, src, tgt) where rel in ('SUPPORTS', 'CONTRADICTS') group by all")
def join_8_flags(c: DataFrame) -> DataFrame:
    return counted(P.flag_conflicts(edges_of(c), P.detect_conflicts(c)).where("conflict_flag"), "rel")


@over_graph(
    "join_9_new_conflicts",
    _CONFLICTS
    + """ select k.* from k
    where exists (select 1 from claims c where c.ws = k.ws and c.src = k.src and c.tgt = k.tgt and c.rel in ('SUPPORTS', 'CONTRADICTS') and c.seq % 10 = 0)""",
)
def join_9(c: DataFrame) -> DataFrame:
    """A tenth of the claims is new."""
    return P.flag_new_conflicts(c.where("seq % 10 <> 0"), c.where("seq % 10 = 0"))


@over_graph(
    "join_12_entity_context",
    _SYM
    + """, asked as (select ws, name from nodes where label = 'Organization'),
    near as (select distinct n.ws, n.name, b as neighbor, rel from asked n join sym on sym.ws = n.ws and lower(a) = lower(name))
    select ws, name, neighbor, rel, count(*) over (partition by ws, name) as degree, true as found from near
    qualify row_number() over (partition by ws, name order by neighbor, rel) <= 25""",
)
def join_12(c: DataFrame) -> DataFrame:
    return P.entity_context(c, G.build_nodes(c).where("label = 'Organization'"))


@over_graph(
    "join_13_connections",
    """, p as (select distinct x.ws, x.src as a, y.tgt as b from claims x join claims y on x.ws = y.ws where x.rel = 'AFFILIATED_WITH' and y.rel = 'ABOUT'),
    sym as (select distinct ws, a, b from (select ws, src as a, tgt as b from edges union all select ws, tgt, src from edges)),
    m as (
        select p.ws, p.a, p.b, string_agg(distinct x.b, ',' order by x.b) as shared, count(distinct x.b) as n_shared
        from p join sym x on x.ws = p.ws and x.a = p.a join sym y on y.ws = p.ws and y.a = x.b and y.b = p.b group by all)
    select p.ws, p.a, p.b, exists (select 1 from sym where sym.ws = p.ws and sym.a = p.a and sym.b = p.b) as direct, coalesce(shared, '') as shared, coalesce(n_shared, 0) as n_shared
    from p left join m using (ws, a, b)""",
)
def join_13(c: DataFrame) -> DataFrame:
    """Every person with a home against every topic of its workspace."""
    people = G.build_nodes(c.where("rel = 'AFFILIATED_WITH'")).where("label = 'Person'").select("ws", F.col("name").alias("a"))
    return P.connections(c, people.join(c.where("rel = 'ABOUT'").select("ws", F.col("tgt").alias("b")).distinct(), "ws"))


@over_graph(
    "set_4_remove_source",
    """, kept as (select * from claims where not (ws = 'ws_building' and source_id = 'src_3'))
    select ws, rel, count(distinct (src_label, src, tgt_label, tgt)) as n from kept group by all""",
)
def set_4(c: DataFrame) -> DataFrame:
    return counted(G.build_edges(G.remove_source(c, "ws_building", "src_3")), "ws", "rel")


@over_graph(
    "set_4_removed_counts",
    """select (select count(*) from nodes where ws = 'ws_building' and source_ids = 'src_3')::bigint as nodes_removed,
    (select count(*) from edges where ws = 'ws_building' and source_ids = 'src_3')::bigint as edges_removed""",
)
def set_4_counts(c: DataFrame) -> DataFrame:
    return G.removal_counts(c, "ws_building", "src_3")


@over_graph("set_7_delete_workspace", "select ws, count(*) as n from claims where ws <> 'ws_building' group by all")
def set_7(c: DataFrame) -> DataFrame:
    return counted(G.without_workspace(c, "ws_building"), "ws")


@over_graph("set_1_union_rows", "select ws, src, tgt from claims where rel = 'SUPPORTS' union select ws, src, tgt from claims where rel = 'CONTRADICTS'")
def set_1(c: DataFrame) -> DataFrame:
    return G.union_rows(c.where("rel = 'SUPPORTS'").select("ws", "src", "tgt"), c.where("rel = 'CONTRADICTS'").select("ws", "src", "tgt"))


_HUBS = (
    _SYM
    + """, d as (select ws, a as name, count(*) as n from sym group by all),
    h as (select ws, name from d qualify row_number() over (partition by ws order by n desc, name) <= 25),
    t as (select * from edges where (ws, src) in (select (ws, name) from h) or (ws, tgt) in (select (ws, name) from h)),
    s2 as (select ws, src as name from t union all select ws, tgt from t),
    g as (select ws, name, count(*)::bigint as degree from s2 group by all),
    v as (select ws, name, degree, row_number() over (partition by ws order by degree desc, name)::bigint as rank from g qualify rank <= 150)"""
)


@over_graph("top_1_hub_view", _HUBS + " select * from v")
def top_1(c: DataFrame) -> DataFrame:
    return G.hub_view(G.edge_keys(c))[0].withColumn("rank", F.col("rank").cast("long"))


@over_graph("top_1_hub_edges", _HUBS + " select ws, src_label, src, rel, tgt_label, tgt from t where (ws, src) in (select (ws, name) from v) and (ws, tgt) in (select (ws, name) from v)")
def top_1_edges(c: DataFrame) -> DataFrame:
    return G.hub_view(G.edge_keys(c))[1].select(*G.EDGE)
