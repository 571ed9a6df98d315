"""Driver queries of graph analytics over the derived graph: all relations, but for link scores of all pairs and most forms of gaps, which are of the graph of papers and their authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import analytics as A
from kgspark.operators import evidence as V
from kgspark.operators import graph as G
from kgspark.plans.registry import over_graph
from kgspark.store import stored

CITING = ("CITED", "AUTHORED")
_IN = "rel in ('CITED', 'AUTHORED')"


def whole(c: DataFrame) -> DataFrame:
    """Weighted edges of all relations, written once as every job reads them often."""
    return stored(G.weighted_edges(G.build_edges(c)), "weighted")


def citing_edges(c: DataFrame) -> DataFrame:
    return G.build_edges(c.where(F.col("rel").isin(*CITING)))


def citing(c: DataFrame) -> DataFrame:
    return stored(G.weighted_edges(citing_edges(c)), "weighted")


def ends(w: DataFrame) -> DataFrame:
    return w.select("ws", F.explode(F.array("s", "t")).alias("name")).distinct()


def by_last_letter(w: DataFrame) -> DataFrame:
    """A fixed labelling: the last character of a name."""
    return ends(w).withColumn("label", F.expr("substr(name, length(name))"))


def _ranks(where: str) -> str:
    """WITH items r0 to r10: ten rounds of weighted PageRank."""
    sql = f""", w as (select ws, src as s, tgt as t, sum(coalesce(nullif(confidence, 0), 1)) as w from edges where {where} and src <> tgt group by all),
    v as (select distinct ws, name from (select ws, s as name from w union all select ws, t from w)),
    nn as (select ws, count(*)::double as n from v group by ws),
    tot as (select ws, s, sum(w) as a from w group by all),
    p as (select w.ws, w.s, w.t, w.w / tot.a as p from w join tot using (ws, s)),
    dang as (select v.ws, v.name, n, tot.a is null as d from v join nn using (ws) left join tot on tot.ws = v.ws and tot.s = v.name),
    r0 as materialized (select *, 1 / n as score from dang)"""
    for i in range(10):
        sql += f""", r{i + 1} as materialized (
        select r.ws, r.name, r.n, r.d, 0.85 * (coalesce(g.got, 0) + l.lost / r.n) + 0.15 / r.n as score
        from r{i} r join (select ws, sum(case when d then score else 0 end) as lost from r{i} group by ws) l on l.ws = r.ws
        left join (select p.ws, p.t, sum(score * p) as got from r{i} q join p on p.ws = q.ws and p.s = q.name group by all) g on g.ws = r.ws and g.t = r.name)"""
    return sql


_LINK = f""", u as (select distinct ws, least(src, tgt) as a, greatest(src, tgt) as b from edges where {_IN} and src <> tgt),
    near as (select ws, a, b from u union all select ws, b, a from u),
    deg as (select ws, a as mid, count(*) as d from near group by all),
    m as (select near.ws, near.a as mid, near.b as n, d from near join deg on deg.ws = near.ws and deg.mid = near.a),
    g as (select x.ws, x.n as a, y.n as c, sum(1 / ln(x.d)) as aa, sum(1.0::double / x.d) as ra, count(*)::bigint as common from m x join m y on x.ws = y.ws and x.mid = y.mid and x.n < y.n group by all),
    link as (select * from g where not exists (select 1 from u where u.ws = g.ws and u.a = g.a and u.b = g.c))"""
_GAPS = """, top as (select ws, max(score) as most from r10 group by ws),
    scored as (
        select link.ws, link.a, link.c, common, right(link.a, 1) = right(link.c, 1) as same_community, right(link.a, 1) <> right(link.c, 1) and common >= 2 as bridge,
               round((aa + ra + 0.25 * common) * case when right(link.a, 1) <> right(link.c, 1) and common >= 2 then 1.15 else 1.0 end * (1 + x.score / most + y.score / most), 6) as score
        from link join r10 x on x.ws = link.ws and x.name = link.a join r10 y on y.ws = link.ws and y.name = link.c join top on top.ws = link.ws),
    gaps as (select *, row_number() over (partition by ws order by score desc, common desc, a desc, c desc)::bigint as rank from scored qualify rank <= 10)"""
_ALL_GAPS = _ranks("true") + _LINK.replace(_IN, "true") + _GAPS
_GAPS = _ranks(_IN) + _LINK + _GAPS


def gaps_of(c: DataFrame, top_n: int = 10) -> DataFrame:
    return gaps_in(citing(c), top_n)


def gaps_in(w: DataFrame, top_n: int = 10) -> DataFrame:
    return A.research_gaps(w, A.pagerank(w, iterations=10), by_last_letter(w), top_n)


@over_graph("gra_1_pagerank_10_iter", _ranks("true") + " select ws, name, round(score, 8) as score from r10")
def gra_1(c: DataFrame) -> DataFrame:
    return A.pagerank(whole(c), iterations=10).withColumn("score", F.round("score", 8))


@over_graph("gra_1_pagerank", None)
def gra_1_converged(c: DataFrame) -> DataFrame:
    return A.pagerank(whole(c))


@over_graph("gra_8_influence_for", _ranks("true") + ", q as (select ws, name, round(score, 8) as score, row_number() over (partition by ws order by round(score, 8) desc, name)::bigint as place from r10) select * from q where (ws, name) in (select (ws, name) from nodes where label = 'Person')")
def gra_8(c: DataFrame) -> DataFrame:
    """The places of all persons among all nodes."""
    ranks = stored(A.pagerank(whole(c), iterations=10).withColumn("score", F.round("score", 8)), "ranks")
    return A.influence_for(ranks, G.build_nodes(c).where("label = 'Person'"))


@over_graph("top_2_influence", _ranks("true") + " select ws, name, round(score, 8) as score, row_number() over (partition by ws order by round(score, 8) desc, name)::bigint as rank from r10 qualify rank <= 25")
def top_2(c: DataFrame) -> DataFrame:
    ranks = A.pagerank(whole(c), iterations=10).withColumn("score", F.round("score", 8))
    return G.top_per_workspace(ranks, "score", 25).withColumn("rank", F.col("rank").cast("long"))


@over_graph("gra_4_common_neighbours", _LINK + " select ws, a, c, common from link")
def gra_4(c: DataFrame) -> DataFrame:
    return A.link_scores(citing(c)).select("ws", "a", "c", "common")


@over_graph("gra_5_link_scores", _LINK + " select ws, a, c, round(aa, 6) as adamic_adar, round(ra, 6) as resource_allocation, common from link")
def gra_5(c: DataFrame) -> DataFrame:
    return A.link_scores(citing(c)).withColumn("adamic_adar", F.round("adamic_adar", 6)).withColumn("resource_allocation", F.round("resource_allocation", 6))


@over_graph("gra_6_research_gaps", _GAPS + " select ws, a, c, common, same_community, bridge, score, rank from gaps")
def gra_6(c: DataFrame) -> DataFrame:
    return gaps_of(c)


@over_graph("gra_6_all_relations", _ALL_GAPS + " select ws, a, c, common, same_community, bridge, score, rank from gaps")
def gra_6_all(c: DataFrame) -> DataFrame:
    """The top gaps over all relations."""
    w = whole(c)
    return A.research_gaps(w, A.pagerank(w, iterations=10), by_last_letter(w))


@over_graph("gra_6_gaps_of_communities", None)
def gra_6_communities(c: DataFrame) -> DataFrame:
    """The top gaps over all relations, with converged ranks and communities."""
    w = whole(c)
    return A.research_gaps(w, A.pagerank(w), A.communities(w, passes=1, tol=1e-3, patience=1))


@over_graph("win_5_gap_strength", _GAPS + " select ws, a, c, case when max(score) over (partition by ws) <= 0 then 'emerging' when score / max(score) over (partition by ws) >= 0.66 then 'strong' when score / max(score) over (partition by ws) >= 0.33 then 'moderate' else 'emerging' end as strength from gaps")
def win_5(c: DataFrame) -> DataFrame:
    return A.gap_strength(gaps_of(c)).select("ws", "a", "c", "strength")


@over_graph("top_5_gaps_by_common", _GAPS + " select ws, a, c, row_number() over (partition by ws order by common desc, score desc, a desc, c desc)::bigint as rank from gaps where bridge")
def top_5(c: DataFrame) -> DataFrame:
    """The top gaps again, by common neighbours, bridges only."""
    return A.ordered_gaps(gaps_of(c), "common", bridges_only=True).select("ws", "a", "c", "rank")


@over_graph("gra_7_found_gaps", _GAPS.replace("qualify rank <= 10", "qualify rank <= 10000") + " select ws, a, c, score, rank from gaps where rank % 2 = 1")
def gra_7(c: DataFrame) -> DataFrame:
    """Every other of the first ten thousand gaps, asked for by its names in capitals and turned round, and one that is of a single name."""
    found = stored(gaps_of(c, 10_000), "gaps")
    asked = found.where("rank % 2 = 1").select("ws", F.upper("c").alias("source"), F.upper("a").alias("target"))
    return A.find_gaps(found, asked.unionByName(found.select("ws", F.col("a").alias("source"), F.col("a").alias("target")))).select("ws", "a", "c", "score", "rank")


_LEGS = """, legs as (select ws, src as x, tgt as y, rel from edges where rel in ('CITED', 'AUTHORED') union select ws, tgt, src, rel from edges where rel in ('CITED', 'AUTHORED')),
    twice as (select distinct gaps.ws, gaps.a, gaps.c, l.y as mid, l.rel as ra, r.rel as rc from gaps join legs l on l.ws = gaps.ws and l.x = gaps.a join legs r on r.ws = gaps.ws and r.x = l.y and r.y = gaps.c),
    per as (select ws, a, c, mid, string_agg(distinct ra, '+' order by ra) as ra, string_agg(distinct rc, '+' order by rc) as rc from twice group by all),
    ev as (select *, row_number() over (partition by ws, a, c order by mid) as k from per)"""


def gaps_with_evidence(c: DataFrame) -> DataFrame:
    """The top gaps with their evidence; edges are built once and serve both."""
    edges = stored(citing_edges(c).select("ws", "src", "rel", "tgt", "confidence"), "edges")
    return V.gap_evidence(gaps_in(stored(G.weighted_edges(edges), "weighted")), edges)


@over_graph("gra_10_evidence", _GAPS + _LEGS + " select ws, a, c, string_agg(mid || ':' || ra || ':' || rc, ',' order by mid) as evidence from ev where k <= 12 group by ws, a, c")
def gra_10(c: DataFrame) -> DataFrame:
    """Evidence of the top gaps, as it goes into the payload for a phrasing model."""
    found = gaps_with_evidence(c)
    body = A.gap_payload(found, G.node_types(G.build_nodes(c)))
    read = F.from_json("payload", "shared_intermediaries array<struct<mid: string, from_a: array<string>, from_c: array<string>>>")["shared_intermediaries"]
    one = F.transform(read, lambda e: F.concat_ws(":", e["mid"], F.array_join(e["from_a"], "+"), F.array_join(e["from_c"], "+")))
    return body.select("ws", "a", "c", F.array_join(one, ",").alias("evidence"))


@over_graph(
    "gra_11_summaries",
    _GAPS
    + _LEGS
    + """ select gaps.ws, gaps.a, gaps.c, 'Both connect to ' || common || ' shared ' || case when common = 1 then 'intermediary' else 'intermediaries' end || ' (' || string_agg(mid, ', ' order by mid) filter (k <= 2)
    || case when common > 2 then '...' else '' end || ') but have no direct link.' || case when bridge then ' Bridges two topic clusters.' else '' end as summary from gaps join ev on ev.ws = gaps.ws and ev.a = gaps.a and ev.c = gaps.c group by gaps.ws, gaps.a, gaps.c, common, bridge""",
)
def gra_11(c: DataFrame) -> DataFrame:
    return A.plain_summary(gaps_with_evidence(c)).select("ws", "a", "c", "summary")


@over_graph(
    "gra_3_modularity",
    """, u as (select ws, least(src, tgt) as a, greatest(src, tgt) as b, sum(coalesce(nullif(confidence, 0), 1)) as w from edges where src <> tgt group by all),
    n2 as (select ws, a, b, w from u union all select ws, b, a, w from u),
    x as (select ws, right(a, 1) as la, right(b, 1) as lb, w from n2),
    m as (select ws, sum(w) as m2, sum(case when la = lb then w else 0 end) as i from x group by ws),
    k as (select ws, sum(d * d) as d2 from (select ws, la, sum(w) as d from x group by all) group by ws)
    select ws, round(i / m2 - d2 / (m2 * m2), 8) as q from m join k using (ws)""",
)
def gra_3(c: DataFrame) -> DataFrame:
    w = whole(c)
    return A.modularity(w, by_last_letter(w)).withColumn("q", F.round("q", 8))


@over_graph("gra_2_communities", None)
def gra_2(c: DataFrame) -> DataFrame:
    """One pass, in which a level ends when a round gains less than a thousandth of modularity; the unit tests hold it, run to rest, against sequential moves."""
    w = whole(c)
    return A.community_table(A.communities(w, passes=1, tol=1e-3, patience=1), w)


def _searches() -> str:
    """WITH items of a search from both ends in turn: levels a0, b0, a1, ... of (root, nd, parent, rel), pairs met after each step, and paths along the parents."""
    sql = """, near as materialized (select ws, x, y, min(rel) as rel from (select ws, lower(src) as x, lower(tgt) as y, rel from edges union all select ws, lower(tgt), lower(src), rel from edges) group by all),
    ask as materialized (select distinct t.ws, lower(t.name) as a, lower(p.name) as b from nodes t join nodes p on p.ws = t.ws and p.label = 'Person' where t.label = 'Topic'),
    a0 as (select distinct ws, a as root, a as nd, null::varchar as parent, null::varchar as rel from ask), b0 as (select distinct ws, b as root, b as nd, null::varchar as parent, null::varchar as rel from ask)"""
    at, met = {"a": 0, "b": 0}, []
    for k in range(1, 6):
        side = "ab"[(k - 1) % 2]
        i = at[side]
        seen = " union all ".join(f"select ws, root, nd from {side}{j}" for j in range(i + 1))
        at[side] += 1
        sql += f""", {side}{i + 1} as materialized (select h.ws, h.root, y as nd, min(x) as parent, arg_min(near.rel, x) as rel from {side}{i} h join near on near.ws = h.ws and near.x = h.nd
        where (h.ws, h.root, y) not in (select (ws, root, nd) from ({seen})) group by all)"""
        before = "".join(f" and (ask.ws, ask.a, ask.b) not in (select (ws, a, b) from m{j})" for j in range(1, k))
        sql += f""", m{k} as materialized (select ask.ws, ask.a, ask.b, {k} as hops, {at["a"]} as la, {at["b"]} as lb, min(a{at["a"]}.nd) as mid from ask join a{at["a"]} on a{at["a"]}.ws = ask.ws and a{at["a"]}.root = ask.a
        join b{at["b"]} on b{at["b"]}.ws = ask.ws and b{at["b"]}.root = ask.b and b{at["b"]}.nd = a{at["a"]}.nd where true{before} group by ask.ws, ask.a, ask.b)"""
        met.append(f"select * from m{k}")
    every = " union all ".join(f"select ws, root, nd, parent, rel, '{x}' as side from {x}{j}" for x in "ab" for j in range(at[x] + 1))
    sql += f", met as ({' union all '.join(met)}), up as materialized ({every})"
    sql += """, walk as (
        select ws, a, b, hops, [mid] as path, []::varchar[] as rels, mid as lo, mid as hi from met
        union all
        select w.ws, w.a, w.b, w.hops, case when l.parent is not null then list_prepend(l.parent, path) else path end || case when h.parent is not null then [h.parent] else [] end,
               case when l.parent is not null then list_prepend(l.rel, rels) else rels end || case when h.parent is not null then [h.rel] else [] end, coalesce(l.parent, lo), coalesce(h.parent, hi)
        from walk w left join up l on l.side = 'a' and l.ws = w.ws and l.root = w.a and l.nd = w.lo left join up h on h.side = 'b' and h.ws = w.ws and h.root = w.b and h.nd = w.hi
        where l.parent is not null or h.parent is not null),
    label as (select ws, lower(name) as name, min(label) as label from nodes group by all),
    typed as (select ws, a, b, list(coalesce(label, '') order by i) as types from (select ws, a, b, unnest(path) as name, generate_subscripts(path, 1) as i from walk where len(rels) = hops) left join label using (ws, name) group by all)"""
    return sql


@over_graph(
    "gra_9_shortest_paths",
    _searches()
    + """ select ask.ws, ask.a, ask.b, hops::bigint as hops, array_to_string(path, chr(31)) as path, array_to_string(rels, chr(31)) as relations, array_to_string(types, chr(31)) as types
    from ask left join (select * from walk where len(rels) = hops) w on w.ws = ask.ws and w.a = ask.a and w.b = ask.b left join typed on typed.ws = ask.ws and typed.a = ask.a and typed.b = ask.b""",
    recursive=True,
)
def gra_9(c: DataFrame) -> DataFrame:
    """From every topic to every person of its workspace, over all relations, with each path's nodes, labels and relations: two of one workspace are never adjacent."""
    nodes = stored(G.build_nodes(c).select("ws", "label", "name"), "nodes")
    pairs = nodes.where("label = 'Topic'").select("ws", F.col("name").alias("a")).join(nodes.where("label = 'Person'").select("ws", F.col("name").alias("b")), "ws")
    found = A.path_types(A.shortest_paths(stored(G.build_edges(c).select("ws", "src", "rel", "tgt"), "edges"), pairs), nodes)
    flat = lambda x: F.array_join(x, "\x1f").alias(x)
    return found.select("ws", "a", "b", "hops", flat("path"), flat("relations"), flat("types"))
