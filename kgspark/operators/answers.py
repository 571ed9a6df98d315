"""Answers and their evidence: cleaning of model output, evidence payloads, verdicts, export, and figures over sources, threads and result rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions.text import bucket_of
from kgspark.vocab import CONFIDENCE_ELSE, CONFIDENCES, PREDICTED, PREDICTED_ELSE, ROUTE_ELSE, ROUTES

Judge = Callable[[DataFrame], DataFrame]


def one_of(value: Column, allowed: tuple[str, ...], otherwise: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(otherwise)


def route_of(value: Column) -> Column:
    return one_of(F.lower(value), ROUTES, ROUTE_ELSE)


def relation_of(value: Column) -> Column:
    return one_of(value, PREDICTED, PREDICTED_ELSE)


def confidence_of(value: Column) -> Column:
    return one_of(F.lower(value), CONFIDENCES, CONFIDENCE_ELSE)


def category_slugs(names: Column, most: int = 4) -> Column:
    """The first category names that hold a dot and have 3 to 20 characters."""
    return F.slice(F.filter(names, lambda x: x.contains(".") & F.char_length(x).between(3, 20)), 1, most)


def embed_text(name: Column, kind: Column, aliases: Column) -> Column:
    """What is embedded of an entity: name, type and known aliases."""
    known = F.array_join(F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: a != ""), ", ")
    some = F.size(F.coalesce(aliases, F.array().cast("array<string>"))) > 0
    return F.concat_ws(" | ", F.trim(name), F.concat(F.lit("type: "), kind), F.when(some, F.concat(F.lit("aka "), known)))


def key_entities(raw: Column, most: int = 6) -> Column:
    """Of a JSON array the entities that have a name and a type, with texts cut to their lengths; bad JSON gives none."""
    rows = F.from_json(raw, "array<struct<name: string, type: string, role: string>>")
    kept = F.filter(rows, lambda e: (F.coalesce(e["name"], F.lit("")) != "") & (F.coalesce(e["type"], F.lit("")) != ""))
    cut = lambda e: F.struct(F.substring(e["name"], 1, 100).alias("name"), e["type"].alias("type"), F.substring(F.coalesce(e["role"], F.lit("")), 1, 200).alias("role"))
    return F.coalesce(F.slice(F.transform(kept, cut), 1, most), F.array().cast("array<struct<name: string, type: string, role: string>>"))


INSIGHT = (
    "type string, title string, x_label string, y_label string, color string, data array<struct<name: string, value: double>>, steps array<struct<entity: string, entity_type: string, relation: string>>, "
    "stats array<struct<label: string, value: string, subtitle: string>>, columns array<string>, rows array<array<string>>, events array<struct<year: string, label: string, detail: string>>"
)


def insights(raw: Column, most: int = 4) -> Column:
    """Of a JSON array of charts the well-formed ones of the five known shapes, with texts and lists cut to their lengths, as an array of JSON objects; bad JSON gives none."""
    empty = F.lit("")
    text = lambda c, n, default="": F.substring(F.coalesce(c, F.lit(default)), 1, n)
    maybe = lambda c, n: F.when(F.coalesce(c, empty) != "", F.substring(c, 1, n))
    some = lambda c: F.filter(c, lambda x: x.isNotNull())

    def one(item: Column) -> Column:
        x = F.from_json(item, INSIGHT)
        title = text(x["title"], 60).alias("title")
        kind = x["type"].alias("type")
        data = F.transform(some(x["data"]), lambda d: F.struct(text(d["name"], 30).alias("name"), F.coalesce(d["value"], F.lit(0.0)).alias("value")))
        steps = F.transform(some(x["steps"]), lambda s: F.struct(text(s["entity"], 80).alias("entity"), F.coalesce(s["entity_type"], F.lit("Concept")).alias("entity_type"), s["relation"].alias("relation")))
        stats = F.transform(some(x["stats"]), lambda s: F.struct(text(s["label"], 40).alias("label"), text(s["value"], 20).alias("value"), maybe(s["subtitle"], 60).alias("subtitle")))
        columns, rows = F.transform(x["columns"], lambda c: text(c, 40)), F.transform(some(x["rows"]), lambda r: F.transform(r, lambda v: text(v, 60)))
        events = F.transform(some(x["events"]), lambda e: F.struct(text(e["year"], 10).alias("year"), text(e["label"], 60).alias("label"), maybe(e["detail"], 200).alias("detail")))
        bars = F.struct(kind, title, F.coalesce(x["x_label"], empty).alias("x_label"), F.coalesce(x["y_label"], empty).alias("y_label"), F.coalesce(x["color"], F.lit("#c9974a")).alias("color"), F.slice(data, 1, 14).alias("data"))
        return (
            F.when((x["type"] == "bar_chart") & (F.size(data) > 0), F.to_json(bars))
            .when((x["type"] == "flow_path") & (F.size(steps) >= 2), F.to_json(F.struct(kind, title, F.slice(steps, 1, 10).alias("steps"))))
            .when((x["type"] == "stat_grid") & (F.size(stats) > 0), F.to_json(F.struct(kind, F.slice(stats, 1, 8).alias("stats"))))
            .when((x["type"] == "comparison_table") & (F.size(columns) > 0) & (F.size(rows) > 0), F.to_json(F.struct(kind, title, columns.alias("columns"), F.slice(rows, 1, 15).alias("rows"))))
            .when((x["type"] == "timeline") & (F.size(events) > 0), F.to_json(F.struct(kind, title, F.slice(events, 1, 20).alias("events"))))
        )

    items = F.from_json(raw, "array<string>")  # each item as its JSON text
    return F.coalesce(F.slice(some(F.transform(items, one)), 1, most), F.array().cast("array<string>"))


def union_evidence(parts: DataFrame) -> DataFrame:
    """(qid, n_records, n_passages, conflicts) of sub-answers (qid, n, records, passages, conflicts: arrays): all records and passages, conflicts (source, target, ...) once for each pair, the first kept."""
    sums = parts.groupBy("qid").agg(F.sum(F.size(F.coalesce("records", F.array().cast("array<string>")))).alias("n_records"), F.sum(F.size(F.coalesce("passages", F.array().cast("array<string>")))).alias("n_passages"))
    one = parts.select("qid", "n", F.posexplode("conflicts").alias("at", "c"))
    first = one.groupBy("qid", "c.source", "c.target").agg(F.min(F.struct("n", "at", "c")).alias("f"))
    kept = first.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["c"]).alias("conflicts"))
    return sums.join(kept, "qid", "left")


def retrieval_payload(questions: DataFrame, records: DataFrame, degrees: DataFrame, conflicts: DataFrame, influence: DataFrame, passages: DataFrame, most: int = 40_000) -> DataFrame:
    """(qid, counts, payload): what was retrieved for each question as one JSON text of at most `most` characters. Each part is (qid, place, ...)."""
    got = questions.select("qid")
    for name, part in (("graph_records", records), ("entity_degree_context", degrees), ("conflicts", conflicts), ("entity_influence", influence), ("vector_passages", passages)):
        rest = [c for c in part.columns if c not in ("qid", "place")]
        one = part.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*rest).alias("row")))), lambda x: x["row"]).alias(name))
        got = got.join(one, "qid", "left")
    names = [c for c in got.columns if c != "qid"]
    counts = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}") for c in names]
    return got.select("qid", *counts, F.substring(F.to_json(F.struct(*names)), 1, most).alias("payload"))


def lexical_judge(claims: DataFrame) -> DataFrame:
    """A deterministic judge: a claim (qid, place, claim, evidence) is supported if all of its words occur in the evidence."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))
    return claims.withColumn("supported", F.size(F.array_except(words(F.col("claim")), words(F.col("evidence")))) == 0)


def judged_claims(answers: DataFrame, judge: Judge = lexical_judge, most_evidence: int | None = None, most_claim: int = 300) -> DataFrame:
    """(qid, place, claim, supported) of answers (qid, answer, evidence): sentences as claims with a judge's verdicts; blank answers give none, claims without a verdict go."""
    evidence = F.substring("evidence", 1, most_evidence) if most_evidence else F.col("evidence")
    parts = F.filter(F.transform(F.split(F.coalesce("answer", F.lit("")), "[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    rows = answers.select("qid", evidence.alias("evidence"), F.posexplode(parts).alias("place", "claim"))
    return judge(rows).where("supported is not null").select("qid", "place", F.substring("claim", 1, most_claim).alias("claim"), "supported")


def markdown_report(reports: DataFrame) -> DataFrame:
    """(report_id, markdown) of reports (report_id, question, answer, route, version, n_records, n_conflicts, supported, total, query, passages: array of (title, url, text))."""
    line = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    share = F.when(F.coalesce("total", F.lit(0)) == 0, "n/a").otherwise(
        F.concat(F.round(F.col("supported") / F.col("total") * 100).cast("long").cast("string"), F.lit("% ("), F.col("supported").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" claims)"))
    )
    head = F.array(
        F.concat(F.lit("# "), "question"), F.lit(""), F.coalesce("answer", F.lit("")), F.lit(""), F.lit("## Retrieval"), F.lit(""), line("Route", F.col("route")), line("Version", F.col("version").cast("string")),
        line("Graph records", F.col("n_records").cast("string")), line("Passages", F.size("passages").cast("string")), line("Conflicts", F.col("n_conflicts").cast("string")), line("Trust score", share),
    )
    none = F.array().cast("array<string>")
    query = F.when(F.coalesce("query", F.lit("")) != "", F.array(F.lit(""), F.lit("## Query"), F.lit(""), F.lit("```"), F.col("query"), F.lit("```"))).otherwise(none)
    one = lambda p, i: F.array(F.lit(""), F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(p["title"], F.lit("Untitled source"))), F.when(F.coalesce(p["url"], F.lit("")) != "", F.concat(F.lit("   "), p["url"])).otherwise(""), F.concat(F.lit("   "), F.coalesce(p["text"], F.lit(""))))
    passages = F.when(F.size("passages") > 0, F.concat(F.array(F.lit(""), F.lit("## Passages")), F.flatten(F.transform("passages", one)))).otherwise(none)
    return reports.select("report_id", F.array_join(F.concat(head, query, passages), "\n").alias("markdown"))


def source_stats(sources: DataFrame) -> DataFrame:
    """Per workspace of sources (ws, status, type): totals by state and kind, and readiness in percent (100 once none fails or is active)."""
    state = lambda *s: F.count_if(F.col("status").isin(*s))
    kind = lambda k: F.count_if(F.col("type") == k)
    got = sources.groupBy("ws").agg(
        F.count(F.lit(1)).alias("total"), state("success").alias("ready"), state("pending", "running").alias("active"), state("error").alias("error"),
        kind("arxiv_feed").alias("arxiv"), kind("rss").alias("rss"), kind("web_url").alias("web"), kind("pdf_upload").alias("pdf"),
    )
    busy = (F.col("error") > 0) | (F.col("active") > 0)
    return got.withColumn("readiness", F.when(busy, F.round(F.col("ready") / F.col("total") * 100).cast("long")).otherwise(F.lit(100).cast("long")))


def mean_of(rows: DataFrame, hit: Column, out: str) -> DataFrame:
    """The share of rows where `hit` holds, 0 of none: routing accuracy, hit rate."""
    return rows.agg(F.coalesce(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), F.lit(0.0)).alias(out))


def cut_fraction(edges: DataFrame, buckets: int) -> DataFrame:
    """The share of edges whose ends hash to different ones of `buckets` partitions."""
    return edges.agg(F.coalesce(F.avg((bucket_of(F.col("src"), buckets) != bucket_of(F.col("tgt"), buckets)).cast("double")), F.lit(0.0)).alias("cut"))


def thread_summary(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, last_type) of turns (conv_id, turn_index, retrieval_type, created_at): a null index counts as 0, the newest of equals is the last."""
    at = F.struct(F.coalesce("turn_index", F.lit(0)).alias("i"), "created_at", "retrieval_type")
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max(at).alias("m")).select("conv_id", "turns", F.col("m.retrieval_type").alias("last_type"))


def record_profile(records: DataFrame) -> DataFrame:
    """Per question of result rows (qid, from, rel, to): distinct relation types, entities and paths; names of 120 characters or more, and blank ones, are none."""
    name = lambda c: (F.trim(c) != "") & (F.char_length(c) < 120)
    rel = F.col("rel").rlike("^[A-Z][A-Z_]+$")
    ends = F.array(F.when(name("from"), F.col("from")), F.when(name("to"), F.col("to")))
    per = records.select("qid", F.explode(F.array_compact(ends)).alias("e")).groupBy("qid").agg(F.count_distinct("e").alias("entities"))
    whole = records.groupBy("qid").agg(F.count_distinct(F.when(rel, F.col("rel"))).alias("rel_types"), F.count_distinct(F.when(name("from") & name("to") & rel, F.struct("from", "rel", "to"))).alias("paths"))
    return whole.join(per, "qid", "left").select("qid", "rel_types", F.coalesce("entities", F.lit(0)).alias("entities"), "paths")


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ws, source, target, source_type, target_type, relation_type, confidence): edges of named nodes that aren't stubs; a missing confidence is 1."""
    stub = F.coalesce(nodes["is_stub"], F.lit(False)) if "is_stub" in nodes.columns else F.lit(False)
    real = nodes.where(nodes["name"].isNotNull() & ~stub).select("ws", "label", "name").distinct()
    for side in ("src", "tgt"):
        edges = edges.join(real.select("ws", F.col("label").alias(f"{side}_label"), F.col("name").alias(side)), ["ws", f"{side}_label", side], "left_semi")
    return edges.select("ws", F.col("src").alias("source"), F.col("tgt").alias("target"), F.col("src_label").alias("source_type"), F.col("tgt_label").alias("target_type"), F.col("rel").alias("relation_type"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"))


def first_names(records: DataFrame) -> DataFrame:
    """(qid, ws, name, place) of names (qid, ws, name): each once, in order of name, as questions for conflicts."""
    once = records.select("qid", "ws", "name").distinct()
    return once.withColumn("place", F.row_number().over(W.partitionBy("qid", "ws").orderBy("name")))
