from kgspark.operators import evidence as E
from kgspark.sources import feeds
from kgspark.streaming import jobs


def test_routes_fall_back_unless_forced(spark):
    rows = [(1, "graph", False, 0, 0, 5), (2, "graph", True, 0, 0, 5), (3, "vector", False, 0, 0, 0), (4, "hybrid", False, 1, 1, 1), (5, "graph", False, None, 2, 0)]
    q = spark.createDataFrame(rows, "qid long, route string, forced boolean, records long, stats long, chunks long")
    assert {r.qid: (r.use_graph, r.use_vector) for r in E.effective_route(q).collect()} == {1: (True, True), 2: (True, False), 3: (True, True), 4: (True, True), 5: (True, False)}


def test_names_and_entities(spark):
    v = spark.createDataFrame([(1, 0, 0, "Ada"), (1, 0, 1, "NASA"), (1, 1, 0, "http://x"), (1, 1, 1, "Bob L"), (1, 2, 0, "Ada"), (1, 2, 1, "ab"), (1, 50, 0, "Late")], "qid long, row long, pos long, value string")
    assert [r.name for r in E.candidate_names(v).orderBy("place").collect()] == ["Ada", "Bob L"]
    e = spark.createDataFrame([(1, 0, " Ada"), (1, 1, "ada"), (1, 2, " ")], "qid long, pos long, name string")
    assert [r.pos for r in E.first_entities(e).collect()] == [0]


def test_versions_and_visibility(spark):
    r = spark.createDataFrame([(1, "w", "q", "u", 1), (2, "w", "q", None, 2), (3, "w", "q", "u", 3), (4, "w", "q", "v", 4)], "report_id long, ws string, question string, user string, created_at long")
    assert {x.report_id: x.version for x in E.report_versions(r).collect()} == {1: 1, 2: 1, 3: 3, 4: 2}
    ws = spark.createDataFrame([("w", None)], "ws string, owner string")
    none = spark.createDataFrame([], "ws string, user string")
    assert {x.report_id for x in E.visible_reports(r, ws, none, "u").collect()} == {1, 2, 3}
    assert E.visible_reports(r, ws, spark.createDataFrame([("w", "u")], "ws string, user string"), "u").count() == 0


def test_gap_evidence_lists_both_legs(spark):
    e = spark.createDataFrame([("w", "A", "M", "X"), ("w", "C", "M", "Y"), ("w", "M", "A", "Z")], "ws string, src string, tgt string, rel string")
    got = E.gap_evidence(spark.createDataFrame([("w", "A", "C"), ("w", "A", "Q")], "ws string, a string, c string"), e).collect()
    assert {r.c: [(x.mid, x.from_a, x.from_c) for x in r.evidence or []] for r in got} == {"C": [("M", ["X", "Z"], ["Y"])], "Q": []}


def test_gap_evidence_finds_gaps_once(spark):
    e = spark.createDataFrame([("w", "A", "X", "m"), ("w", "m", "Y", "C")], "ws string, src string, rel string, tgt string")
    found = spark.sparkContext.accumulator(0)

    def gap(rows):
        for r in rows:
            found.add(1)
            yield r

    gaps = spark.createDataFrame(spark.sparkContext.parallelize([("w", "A", "C")], 1).mapPartitions(gap), "ws string, a string, c string")
    assert [m.mid for m in E.gap_evidence(gaps, e).first().evidence] == ["m"] and found.value == 1


def test_feeds_and_uploads(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><id>http://x/abs/1.2v1</id><title>A\n b</title><summary>s</summary><published>2020</published><author><name>N</name></author><author><name> </name></author><category term="cs.AI"/></entry></feed>')
    a = feeds.atom_documents(spark, str(tmp_path / "a.xml")).first()
    assert (a.doc_id, a.title, a.authors, a.categories) == ("1.2v1", "A b", ["N"], ["cs.AI"])
    (tmp_path / "r.xml").write_text("<rss><channel>" + "".join(f"<item><title>t{i}</title><link>http://l/{i}</link><description>d</description></item>" for i in range(60)) + "</channel></rss>")
    r = feeds.rss_documents(spark, str(tmp_path / "r.xml")).collect()
    assert len(r) == 50 and (r[0].doc_id, r[0].text) == ("http://l/0", "d")
    files = [("/u/0a0a0a0a-1111-2222-3333-444444444444_Pa per.pdf", 9, bytearray(b"%PDF-1.4 ")), ("/u/e.pdf", 0, bytearray()), ("/u/t?.txt", 3, bytearray(b"abc"))]
    got = {r.path: r for r in feeds.triage_uploads(spark.createDataFrame(files, "path string, length long, content binary")).collect()}
    assert (got[files[0][0]].title, got[files[0][0]].accepted) == ("Pa per", True)
    assert (got["/u/e.pdf"].reason, got["/u/t?.txt"].reason, got["/u/t?.txt"].name) == ("empty", "not a PDF", "t_.txt.pdf")


def test_streams_equal_batches(spark, tmp_path):
    log = spark.createDataFrame([(i, f"2024-01-01 0{i % 3}:10:00", "failed" if i % 2 else "running") for i in range(12)], "id long, at string, status string").selectExpr("id", "cast(at as timestamp) as ts", "status")
    src = str(tmp_path / "log")
    log.repartition(3).write.parquet(src)
    s = jobs.failures_by_window(jobs.table_stream(spark, src, 1))
    jobs.latest(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    want = {(r.start, r.failures) for r in jobs.failures_by_window(log).collect()}
    assert {(r.start, r.failures) for r in jobs.last_batch(spark, str(tmp_path / "out"), s.schema).collect()} == want
    for _ in range(2):  # a second run finds nothing new
        jobs.ingest(jobs.table_stream(spark, src), lambda b: b.where("status = 'failed'"), str(tmp_path / "kept"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 6
