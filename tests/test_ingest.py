import uuid

import pytest
from pyspark.sql import functions as F

from kgspark.functions import text as T
from kgspark.operators import answers as A
from kgspark.operators import graph as G
from kgspark.operators import ingest as I
from kgspark.operators import retrieval as R
from kgspark.operators import upkeep as U
from kgspark.sources.documents import read_documents
from kgspark.sources.pages import extract_pages
from kgspark.streaming import jobs

DOC = "ws string, source_id string, seq long, doc_id string, title string, text string, authors array<string>, categories array<string>, url string, published string"


def documents(spark, rows):
    return spark.createDataFrame([("w", "s", i, d, t, x, a, c, u, "") for i, (d, t, x, a, c, u) in enumerate(rows)], DOC)


def test_extraction_merges_windows(spark):
    e = [("w", "d", 0, 0, "Deep Nets", "Concept", ["DN"]), ("w", "d", 0, 1, " ", "Concept", []), ("w", "d", 0, 2, "X", "Gadget", []), ("w", "d", 1, 0, "deep nets", "Concept", ["NN", "DN"]), ("w", "d", 1, 1, "deep nets", "Topic", None)]
    found = spark.createDataFrame(e, "ws string, doc_id string, window int, pos int, name string, type string, aliases array<string>")
    assert sorted((r.name, r.type, r.aliases) for r in I.merge_entities(found).collect()) == [("Deep Nets", "Concept", ["DN", "NN"]), ("deep nets", "Topic", [])]
    r = [("w", "d", 0, 0, "A", "B", "USES", "first", None), ("w", "d", 0, 1, "a", "b", "USES", "best", 0.9), ("w", "d", 1, 0, "A", "B", "USES", "late", 0.9), ("w", "d", 1, 1, "A", "B", "EATS", "", 1.0), ("w", "d", 1, 2, " ", "B", "USES", "", 1.0)]
    found = spark.createDataFrame(r, "ws string, doc_id string, window int, pos int, source string, target string, type string, context string, confidence double")
    assert [(x.source, x.context) for x in I.merge_relations(found).collect()] == [("a", "best")]


def test_failed_windows_are_skipped(spark):
    docs = documents(spark, [("1", "t", "alphas betas gammas", [], [], "u1")])
    words = spark.createDataFrame([("alphas",), ("betas",)], "word string")
    model = I.dictionary_model(words)
    wins = I.windows(docs, size=12, overlap=4)
    assert wins.count() > 1
    fails = lambda w: model(w).withColumn("entities", F.when(F.col("window") > 0, F.col("entities")))
    all_names = {r.name for r in I.extract(docs, model, size=12, overlap=4)[0].collect()}
    assert {r.name for r in I.extract(docs, fails, size=12, overlap=4)[0].collect()} < all_names == {"alphas", "betas"}


def test_claims_of_documents(spark):
    docs = documents(spark, [("1", "t", "x", ["Ann", " "], ["cs.AI", ""], "u1")])
    names = spark.createDataFrame([("w", "1", i, n, t, n.upper()) for i, (n, t) in enumerate([("a", "Concept"), ("b", "Topic"), ("c", "Organization"), ("d", "Event"), ("e", "Person"), ("f", "Paper"), ("a", "Topic")])], "ws string, doc_id string, pos int, name string, type string, canonical string")
    rels = spark.createDataFrame([("w", "1", "a", "e", "USES", "c" * 600, None), ("w", "1", "a", "zz", "USES", "", 1.0)], "ws string, doc_id string, source string, target string, type string, context string, confidence double")
    got = {(r.src_label, r.src, r.rel, r.tgt_label, r.tgt, r.confidence) for r in I.document_claims(docs, names, rels).collect()}
    assert got == {("Person", "Ann", "AUTHORED", "Paper", "1", 1.0), ("Paper", "1", "ABOUT", "Topic", "cs.AI", 1.0), ("Paper", "1", "MENTIONS", "Concept", "A", 0.9), ("Paper", "1", "ABOUT", "Topic", "B", 0.9), ("Paper", "1", "ABOUT", "Topic", "A", 0.9),
                   ("Paper", "1", "AFFILIATED_WITH", "Organization", "C", 0.9), ("Paper", "1", "PRESENTED_AT", "Event", "D", 0.9), ("Topic", "A", "USES", "Person", "E", 0.8)}
    assert I.document_claims(docs, names, rels).agg(F.max(F.length("context"))).first()[0] == 500


def test_ingesting_twice_changes_nothing(spark):
    docs = documents(spark, [("1", "one", "alphas betas", ["Ann"], ["c"], "u1"), ("2", "two", None, [], [], ""), ("3", "three", "betas alphas", [], [], "u3")])
    model = I.dictionary_model(spark.createDataFrame([("alphas",), ("betas",)], "word string"))
    none = I.document_chunks(docs).limit(0)
    claims = spark.createDataFrame([], "ws string, src string, tgt string, rel string, doc string")
    first = I.ingest(docs, none, claims, model)
    chunks = I.upsert_chunks(none, first["chunks"]).cache()
    assert chunks.count() == 3 and {r.outcome for r in first["outcome"].collect()} == {"processed"}
    vectors = [r.embedding for r in chunks.collect()]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in vectors)
    again = I.ingest(docs, chunks, first["claims"], model)
    assert again["chunks"].count() == again["claims"].count() == 0 and {r.outcome for r in again["outcome"].collect()} == {"skipped"}
    forced = I.ingest(docs, chunks, first["claims"], model, force=True)
    assert sorted(r.chunk_id for r in I.upsert_chunks(chunks, forced["chunks"]).collect()) == sorted(r.chunk_id for r in chunks.collect())
    assert {tuple(r) for r in forced["claims"].drop("seq").collect()} == {tuple(r) for r in first["claims"].drop("seq").collect()}
    assert G.build_edges(first["claims"]).count() > 0


def test_opposite_claims_are_flagged_on_ingestion(spark):
    docs = documents(spark, [("2", "t", "x", [], [], "u")])
    model = lambda w: w.select("ws", "doc_id", "window", "text", F.from_json(F.lit('[{"name":"A","type":"Concept","aliases":[]},{"name":"B","type":"Concept","aliases":[]}]'), I.ENTITIES).alias("entities"), F.from_json(F.lit('[{"source":"A","target":"B","type":"CONTRADICTS","context":"","confidence":1.0}]'), I.RELATIONS).alias("relations"))
    old = spark.createDataFrame([("w", "A", "B", "SUPPORTS", "1")], "ws string, src string, tgt string, rel string, doc string")
    got = I.ingest(docs, I.document_chunks(docs).limit(0), old, model)
    assert [(r.src, r.tgt, r.matches) for r in got["conflicts"].collect()] == [("A", "B", 1)]
    assert got["flag"](old.withColumn("confidence", F.lit(1.0))).first().conflict_flag


def test_deletions_spare_claimed_papers(spark):
    nodes = spark.createDataFrame([("w", "Paper", "p", "u1", ["s"]), ("w", "Paper", "q", "u1", []), ("w", "Concept", "c", None, []), ("w", "Concept", "d", None, ["s"])], "ws string, label string, name string, url string, source_ids array<string>")
    edges = spark.createDataFrame([("w", "Paper", "q", "MENTIONS", "Concept", "c", "q"), ("w", "Concept", "d", "USES", "Concept", "d", "p")], "ws string, src_label string, src string, rel string, tgt_label string, tgt string, doc string")
    urls = spark.createDataFrame([("w", "u1")], "ws string, document_url string")
    n, e = U.remove_untagged_documents(nodes, edges, urls)
    assert sorted(r.name for r in n.collect()) == ["d", "p"] and [r.src for r in e.collect()] == ["d"]
    n, e = U.delete_documents(nodes, edges, urls)
    assert n.count() == e.count() == 0


def test_chunk_deletes(spark):
    chunks = spark.createDataFrame([("w", "1", "u", "s"), ("w", "2", None, ""), ("v", "3", "u", "s")], "ws string, chunk_id string, source_url string, source_id string")
    by = lambda col, v: sorted(r.chunk_id for r in U.delete_chunks(chunks, spark.createDataFrame([("w", v)], f"ws string, {col} string")).collect())
    assert by("source_url", "u") == ["2", "3"] and by("source_id", "s") == ["2", "3"] and by("source_id", "") == ["1", "2", "3"]


@pytest.mark.parametrize(("url", "want"), [("http://example.com/a", True), ("https://8.8.8.8:80/", True), ("ftp://example.com", False), ("http://", False), ("http://127.0.0.1/", False), ("http://10.1.2.3", False), ("http://169.254.169.254/x", False), ("http://[::1]/", False), ("http://[2606:4700::1]/", True),
                                           ("http://[::ffff:8.8.8.8]/", False), ("http://198.18.0.1/", False), ("http://192.0.2.5", False), ("http://2130706433/", False), ("http://u:p@127.0.0.1/", False), ("http://127.0.0.1.example.com/", True), (None, False)])
def test_public_urls(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(T.public_url(F.col("u"))).first()[0] is want


def test_feed_specs(spark):
    specs = {"cs.AI,": "category", "cs.AI, q-bio.NC": "category", "cs": "keyword", "q-bio.NC2": "category", "math/0211159v1": "id", "2401.12345": "id", "about 2401.12345x": "keyword", "https://arxiv.org/abs/2401.12345v2": "id", "": "default", None: "default"}
    df = spark.createDataFrame([(k,) for k in specs], "s string")
    assert {r.s: r.m for r in df.select("s", T.source_mode(F.col("s")).alias("m")).collect()} == specs


def test_read_only_job_ids_and_chunks(spark):
    q = {"MATCH (n) RETURN n": True, "match (n) set n.x = 1": False, "LOAD   csv from 'x' as r": False, "MATCH (n:Load) RETURN n.loaded": True, "RETURN 'asset'": True, " ": False}
    df = spark.createDataFrame([(k,) for k in q], "s string")
    assert {r.s: r.m for r in df.select("s", T.is_read_only(F.col("s")).alias("m")).collect()} == q
    got = spark.createDataFrame([("src", "http://é/x")], "a string, b string").select(T.job_id(F.col("a"), F.col("b"))).first()[0]
    assert got == str(uuid.uuid5(uuid.UUID(hex=T.JOB_NAMESPACE), "src:http://é/x"))
    text = " ".join(f"w{i}" for i in range(950))
    cut = spark.createDataFrame([(text,), ("a  b",), ("",)], "t string").select(T.chunk_words(F.col("t"))).collect()
    assert [len(c.split()) for c in cut[0][0]] == [400, 400, 230] and cut[1][0] == ["a  b"] and cut[2][0] == [""]
    assert cut[0][0][0].split()[-40:] == cut[0][0][1].split()[:40]
    assert spark.createDataFrame([("a b c",)], "t string").select(T.chunk_words(F.col("t"), 2, 1)).first()[0] == ["a b", "b c"]


def test_pages_keep_the_title_once(spark, tmp_path):
    html = "<html><head><title> A  b</title><style>x</style></head><body><nav>no</nav><svg><title>icon</title></svg><p>c<br>d &amp; e<script>1</script></p><!-- z --></body></html>"
    pages = spark.createDataFrame([(1, "http://x/1", html), (2, "http://x/2", None)], "page_id long, url string, html string")
    assert [(r.title, r.text) for r in extract_pages(pages).orderBy("page_id").collect()] == [("A b", "A b icon c d & e"), ("http://x/2", "")]
    pages.write.parquet(str(tmp_path / "pages"))
    got = read_documents(spark, "web_url", str(tmp_path / "pages")).orderBy("url").collect()
    assert [(r.title, r.url, len(r.doc_id)) for r in got] == [("A b", "http://x/1", 16), ("http://x/2", "http://x/2", 16)]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "up" / "...").write_bytes(b"no")
    assert [r.title for r in read_documents(spark, "pdf_upload", str(tmp_path / "up")).collect()] == ["a"]
    with pytest.raises(ValueError, match="unknown kind"):
        read_documents(spark, "other", "x")


def test_insights_keep_well_formed_charts(spark):
    raw = '[{"type":"bar_chart","title":"t","data":[{"name":"a","value":1}]},{"type":"flow_path","steps":[{"entity":"a"}]},{"type":"stat_grid","stats":[{"label":"l","value":"v"}]},{"type":"comparison_table","columns":["c"],"rows":[["1"]]},{"type":"timeline","events":[{"year":"2020","label":"x"}]},{"type":"pie"},5]'
    df = spark.createDataFrame([(raw,), ("nonsense",), (None,)], "r string")
    got = [r[0] for r in df.select(A.insights(F.col("r"))).collect()]
    import json

    assert [json.loads(x)["type"] for x in got[0]] == ["bar_chart", "stat_grid", "comparison_table", "timeline"] and got[1] == got[2] == []
    assert json.loads(got[0][0]) == {"type": "bar_chart", "title": "t", "x_label": "", "y_label": "", "color": "#c9974a", "data": [{"name": "a", "value": 1.0}]}
    ents = spark.createDataFrame([('[{"name":"n","type":"t"},{"name":"","type":"t"},{"type":"t"}]',), ("x",)], "r string").select(A.key_entities(F.col("r")).alias("e")).collect()
    assert [[(e.name, e.role) for e in r.e] for r in ents] == [[("n", "")], []]


def test_streams_of_job_states_equal_batches(spark, tmp_path):
    kinds = ["queued", "running", "success", "failed"]
    log = spark.createDataFrame([(f"s{i % 3}", f"d{i % 5}", kinds[(i * 7) % 4], i, f"2024-01-01 0{i % 6}:00:00") for i in range(40)], "source_id string, document_url string, status string, event_id long, at string").selectExpr("source_id", "document_url", "status", "event_id", "cast(at as timestamp) as ts")
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    as_of = F.lit("2024-01-01 05:30:00").cast("timestamp")
    for name, step in (("states", R.job_states), ("stuck", lambda df: jobs.stuck_at(df, as_of))):
        s = step(jobs.table_stream(spark, str(tmp_path / "log"), 1))
        jobs.latest(s, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination()
        batch = {tuple(r) for r in (R.job_states(log) if name == "states" else R.stuck(log, as_of)).collect()}
        assert {tuple(r) for r in jobs.last_batch(spark, str(tmp_path / name), s.schema).collect()} == batch


def test_sql_table_functions_equal_columns(spark):
    from kgspark.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([(1, "a b  c d e"), (2, "x"), (3, "abcdefghij klm")], "id int, t string")
    df.createOrReplaceTempView("sql_docs")
    got = {tuple(r) for r in spark.sql("select d.id, c.* from sql_docs d, lateral chunk_words(d.t, 2, 1) c").collect()}
    assert got == {tuple(r) for r in df.select("id", F.posexplode(T.chunk_words(F.col("t"), 2, 1))).collect()} and (1, 1, "b c") in got
    got = {tuple(r) for r in spark.sql("select d.id, c.* from sql_docs d, lateral char_windows(d.t, 4, 1) c").collect()}
    assert got == {tuple(r) for r in df.select("id", F.posexplode(T.char_windows(F.col("t"), 4, 1))).collect()}


def test_json_models_survive_bad_answers(spark):
    def answer(batches):
        for pdf in batches:
            yield pdf[["id"]].assign(json=['{"n": 5}' if i == 1 else "nonsense" if i == 2 else "[1]" for i in pdf["id"]])

    got = R.apply_json_model(spark.range(1, 4), answer, "id", "n long")
    assert {r.id: r.n for r in got.collect()} == {1: 5, 2: None, 3: None}


def test_page_texts_after_unclosed_elements(spark):
    cases = [
        ("<div><nav>menu</div><p>body text</p>", "body text"), ("<p>a</nav>b</p>", "a b"), ("<header><h1>x<footer>y</header>z", "z"), ("a<br>b<img src=x>c", "a b c"),
        ("<nav/>kept<aside />too", "kept too"), ("<script>if (a < b) { }</script>c", "c"), ("<nav>left open", ""), ("<title>T</title><svg><title>u</title></svg>v", "T u v"),
    ]
    pages = spark.createDataFrame([(i, f"http://x/{i}", html) for i, (html, _) in enumerate(cases)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in extract_pages(pages).collect()} == {i: text for i, (_, text) in enumerate(cases)}


def test_identifiers_of_the_published_scheme(spark):
    good = ["2401.12345", "0704.0001v2", "math/0211159", "cs.AI/0001001v1", "hep-th/9901001", "https://arxiv.org/abs/2401.12345v2", "http://www.arxiv.org/pdf/cs.AI/0001001.PDF"]
    bad = ["240.12345", "2401.123", "2401.123456", "math/021115", "Math/0211159", "cs.ai/0001001", "2401.12345v", "https://example.org/abs/2401.12345", "https://arxiv.org/list/cs", "https://arxiv.org/abs/1?x=1", "v2", "/0211159", "cs./0001001"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string").select("t", T.source_ids(F.col("t")).alias("ids"))
    assert {r.t for r in df.collect() if r.ids} == set(good)
    modes = {"cs.AI, q-bio.NC": "category", "cs.AI, 1x.y": "keyword", "cs": "keyword", "astro-ph.CO": "category", "a.b.c": "keyword", "Cs.AI": "keyword"}
    df = spark.createDataFrame([(t,) for t in modes], "t string").select("t", T.source_mode(F.col("t")).alias("m"))
    assert {r.t: r.m for r in df.collect()} == modes
