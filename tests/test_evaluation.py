from pyspark.sql import functions as F

from kgspark.operators import answers as A
from kgspark.operators import evidence as V
from kgspark.operators import graph as G
from kgspark.operators import retrieval as R
from kgspark.streaming import jobs as J


def test_expected_strings_in_blocks(spark):
    texts = spark.createDataFrame([(1, "The Cat sat"), (2, "concatenate"), (3, None), (4, "")], "text_id long, text string")
    want = spark.createDataFrame([(10, "cat"), (11, "CAT SAT"), (12, ""), (13, None), (14, "cat"), (15, "dog")], "item_id long, text string")
    for size in (4 << 20, 4):
        got = {tuple(r) for r in R.expected_hits(texts, want, size).collect()}
        assert got == {(10, 1), (10, 2), (14, 1), (14, 2), (11, 1)}
    q = spark.createDataFrame([(1, ["CAT"]), (2, ["dog"]), (3, []), (4, []), (5, None)], "qid long, expected array<string>")
    found = spark.createDataFrame([(1, "a cat"), (2, "a cat"), (3, "x"), (5, "y")], "qid long, text string")
    assert {r.qid: r.hit for r in R.retrieval_hit(found, q).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_history_keeps_to_its_budget(spark):
    t = spark.createDataFrame([(1, 0, "user", "a" * 50), (1, 1, "assistant", "b c " * 10), (2, 0, "user", "x" * 90), (3, 0, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.history for r in R.history_block(t, 60).collect()}
    assert got[1] == "assistant: " + "b c " * 10 and got[2] == ("user: " + "x" * 90)[:59] + "…" and got[3] == ": "
    short = {r.conv_id: r.history for r in R.history_block(t, 200, most_answer=10).collect()}
    assert short[1] == "user: " + "a" * 50 + "\nassistant: b c b c b…"
    assert [(r.turn, r.aged) for r in R.aged_out(t.where("conv_id = 1"), 1).orderBy("turn").collect()] == [(0, None), (1, 0)]


def test_trust_without_verdicts_is_null(spark):
    c = spark.createDataFrame([("a", i, f"claim {i}" + "x" * 400, i % 2 == 0) for i in range(30)] + [("b", 0, "c", None)], "answer string, place long, claim string, supported boolean")
    got = {r.answer: r for r in R.trust(c).collect()}
    assert (got["a"].score, got["a"].total, got["a"].supported) == (0.5, 30, 15) and got["a"].unsupported.count(",") == 9 and got["a"].claims.count(",") == 15
    assert max(map(len, got["a"].claims.split(","))) == 300 and (got["b"].score, got["b"].total, got["b"].claims) == (None, 0, "")


def test_percentiles_need_no_common_task(spark):
    rows = [("a", v) for v in (5.0, 1.0, 1.0, 9.0, 3.0)] + [("b", 2.0), ("c", None)]
    got = {r.g: r.value for r in R.nearest_rank(spark.createDataFrame(rows, "g string, v double"), "g", "v", 0.5).collect()}
    assert got == {"a": 3.0, "b": 2.0}


def test_hub_view_keeps_edges_between_its_nodes(spark, tmp_path):
    e = [("w", "P", "h", "R", "P", f"n{i}") for i in range(20)] + [("w", "P", f"n{i}", "R", "P", f"n{i + 1}") for i in range(5)] + [("w", "P", "far", "R", "P", "off")]
    edges = spark.createDataFrame(e, "ws string, src_label string, src string, rel string, tgt_label string, tgt string")
    nodes, inside = G.hub_view(edges, limit=6)
    kept = {r.name for r in nodes.collect()}
    assert len(kept) == 6 and "h" in kept and all({r.src, r.tgt} <= kept for r in inside.collect())
    few = G.hub_view(edges, limit=6, most_edges=3)[1]
    assert few.count() <= 3
    G.write_graph(nodes, edges, str(tmp_path / "g"))
    n, m = G.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 6 and m.count() == len(e) and G.without_workspace(m, "w").count() == 0 and G.in_workspace(m, "w").count() == len(e)


def test_evidence_and_reports(spark):
    parts = spark.createDataFrame([(1, 1, ["r"], ["p", "q"], [("a", "b", "first")]), (1, 2, None, ["s"], [("a", "b", "second"), ("b", "a", "third")])], "qid long, n long, records array<string>, passages array<string>, conflicts array<struct<source: string, target: string, why: string>>")
    r = A.union_evidence(parts).first()
    assert (r.n_records, r.n_passages, [c.why for c in r.conflicts]) == (1, 3, ["first", "third"])
    rep = spark.createDataFrame([(1, "w", "q", "u", 1), (2, "w", "q", "u", 2)], "report_id long, ws string, question string, user string, created_at long")
    old = V.report_versions(rep)
    new = spark.createDataFrame([(3, "w", "q", "u", 3), (4, "w", "z", None, 4)], rep.schema)
    assert {x.report_id: x.version for x in V.append_reports(old, new).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    m = A.markdown_report(spark.createDataFrame([(1, "Q", "A", "graph", 2, 3, 0, 0, 0, "MATCH", [])], "report_id long, question string, answer string, route string, version long, n_records long, n_conflicts long, supported long, total long, query string, passages array<struct<title: string, url: string, text: string>>")).first().markdown
    assert m.endswith("- Trust score: n/a\n\n## Query\n\n```\nMATCH\n```") and "## Passages" not in m


def test_figures_of_nothing(spark):
    none = spark.createDataFrame([], "a int, b int")
    assert A.mean_of(none, F.col("a") == F.col("b"), "x").first().x == 0.0
    letters = spark.createDataFrame([("failed", "e" * 900), ("success", None)], "status string, error string")
    assert [len(r.error) for r in J.failed(letters).collect()] == [500]
    s = spark.createDataFrame([("w", "success", "rss"), ("v", "error", "rss"), ("v", "success", "web_url"), ("v", "running", "x")], "ws string, status string, type string")
    assert {r.ws: (r.readiness, r.active, r.rss) for r in A.source_stats(s).collect()} == {"w": (100, 0, 1), "v": (33, 1, 1)}
