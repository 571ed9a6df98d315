"""Driver queries over texts, pages, evaluation pairs, threads and jobs, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.functions import text as T
from kgspark.operators import evidence as V
from kgspark.operators import retrieval as R
from kgspark.plans.registry import over_tables
from kgspark.sources.pages import extract_pages
from kgspark.store import stored
from kgspark.streaming import jobs as J
from kgspark.streaming import states as S


@over_tables(
    "fn_1_chunks",
    "documents",
    r"""with d as (select doc_id, lang, text, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') as w from documents),
    c as (select doc_id, lang, w, text, unnest(range(0, greatest(0, ceil((len(w) - 400) / 360.0)::bigint) + 1)) as i from d)
    select doc_id, i as chunk_index, 'ws_' || lang || ':doc://' || doc_id || ':' || i as chunk_id,
           case when len(w) <= 400 then text else array_to_string(list_slice(w, i * 360 + 1, i * 360 + 400), ' ') end as text from c""",
)
def fn_1(d: DataFrame) -> DataFrame:
    docs = d.select(F.concat(F.lit("ws_"), "lang").alias("workspace_id"), "doc_id", F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"), "text")
    return T.chunks(docs)


@over_tables(
    "fn_2_char_windows",
    "documents",
    """with d as (select doc_id, 'Document ' || doc_id || '. ' || text as b from documents),
    c as (select doc_id, b, unnest(range(0, case when length(b) <= 6000 then 1 else ceil(length(b) / 5400.0)::bigint end)) as i from d)
    select doc_id, i as n, length(substr(b, i * 5400 + 1, 6000))::bigint as size, md5(substr(b, i * 5400 + 1, 6000)) as digest from c""",
)
def fn_2(d: DataFrame) -> DataFrame:
    body = T.document_body(F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("text"))
    got = d.select("doc_id", F.posexplode(T.char_windows(body)).alias("n", "w"))
    return got.select("doc_id", F.col("n").cast("long").alias("n"), F.char_length("w").cast("long").alias("size"), F.md5("w").alias("digest"))


@over_tables("fn_8_url_ids", "pages", "select page_id, substr(sha256(url), 1, 16) as id from pages")
def fn_8(p: DataFrame) -> DataFrame:
    return p.select("page_id", T.doc_id_of(F.col("url")).alias("id"))


_MOD7 = " + ".join(f"(('0x' || substr(h, {i * 8 + 1}, 8))::bigint % 7) * {pow(pow(2, 32, 7), 7 - i, 7)}" for i in range(8))


@over_tables("fn_9_buckets", "customer", f"with x as (select c_custkey, sha256(lower(trim(c_name))) as h from customer) select c_custkey, ({_MOD7}) % 7 as bucket from x")
def fn_9(c: DataFrame) -> DataFrame:
    return c.select("c_custkey", T.bucket_of(F.col("c_name"), 7).alias("bucket"))


@over_tables(
    "fn_11_trimmed_answers",
    "conversations",
    r"""with x as (select conv_id, turn, role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from conversations),
    y as (select *, substr(t, 1, 100) as cut, instr(reverse(substr(t, 1, 100)), ' ') as gap from x)
    select conv_id, turn, role, case when length(t) <= 100 then t else rtrim(case when gap > 0 and 100 - gap > 60 then substr(t, 1, 100 - gap) else cut end) || '…' end as short from y""",
)
def fn_11(c: DataFrame) -> DataFrame:
    return c.select("conv_id", "turn", "role", T.trim_answer(F.col("text"), 100).alias("short"))


@over_tables("fn_14_json", "events", "select event_id, try_cast(json_extract(props, '$.k') as bigint) as k from events")
def fn_14(e: DataFrame) -> DataFrame:
    return e.select("event_id", T.json_fields(F.col("props"), "k long")["k"].alias("k"))


@over_tables("fn_15_titles", "conversations", "select conv_id, substr(trim(coalesce(nullif(arg_min(text, turn), ''), 'Untitled')), 1, 200) as title from conversations where role = 'user' group by conv_id")
def fn_15(c: DataFrame) -> DataFrame:
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    return first.select("conv_id", T.thread_title(F.col("q")).alias("title"))


@over_tables(
    "fil_9_read_only",
    "conversations",
    r"""select conv_id, turn, k, trim(coalesce(text, '')) <> '' and k not in (1, 2) and not regexp_matches(coalesce(text, ''), '(?i)\b(CREATE|MERGE|SET|DELETE|DETACH|REMOVE|FOREACH|LOAD\s+CSV|CALL|DROP)\b') as read_only
    from conversations, range(4) t(k)""",
)
def fil_9(c: DataFrame) -> DataFrame:
    """Each turn's text as it is, and with one of three endings: a writing clause, a load of a file, and a load of something else."""
    ends = F.array(F.lit(""), F.lit(" set x = 1"), F.lit(" Load  CSV from y"), F.lit(" load balance, reset"))
    rows = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.posexplode(ends).alias("k", "end"))
    query = F.when(F.trim("text") == "", F.col("text")).otherwise(F.concat("text", "end"))
    return rows.select("conv_id", "turn", F.col("k").cast("long").alias("k"), T.is_read_only(query).alias("read_only"))


@over_tables(
    "src_3_page_ids",
    "pages",
    r"""select page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), url) as title, substr(sha256(url), 1, 16) as id from pages""",
)
def src_3_ids(p: DataFrame) -> DataFrame:
    title = F.trim(F.regexp_replace(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return p.select("page_id", F.coalesce(F.nullif(title, F.lit("")), "url").alias("title"), T.doc_id_of(F.col("url")).alias("id"))


@over_tables("src_3_page_texts", "pages")
def src_3_texts(p: DataFrame) -> DataFrame:
    return extract_pages(p).select("page_id", "title", "text")


#: Literal hosts of every kind, and those of them that are public.
_HOSTS = (
    "10.0.0.1", "127.0.0.1", "8.8.8.8", "198.18.0.1", "192.0.2.5", "172.16.9.9", "172.32.0.1", "169.254.1.1", "224.0.0.1", "100.64.0.1", "[::1]", "[2606:4700::1111]", "[fe80::1]", "[2001:db8::1]",
    "localhost", "127.1", "example.org",
)
_OPEN = ("8.8.8.8", "172.32.0.1", "100.64.0.1", "[2606:4700::1111]", "example.org")


@over_tables("src_6_public_urls", "pages", f"select page_id, regexp_matches(url, '(?i)^https?://') as public, h as host, h in {_OPEN} as host_public from pages, (select unnest({list(_HOSTS)}) as h)")
def src_6(p: DataFrame) -> DataFrame:
    """Each page's address as it is, and with its host replaced by one of every kind."""
    rows = p.select("page_id", "url", F.explode(F.array(*map(F.lit, _HOSTS))).alias("host"))
    other = F.concat(F.lit("https://u@"), "host", F.lit(":8080/x?"), "page_id")
    return rows.select("page_id", T.public_url(F.col("url")).alias("public"), "host", T.public_url(other).alias("host_public"))


_SPEC = """case turn % 6 when 0 then text when 1 then 'cs.AI, q-bio.NC' when 2 then 'see math/0211159v1 and 2401.12345v2' when 3 then 'https://arxiv.org/pdf/cs.AI/0001001.pdf' when 4 then ' ' else 'cs' end"""


@over_tables(
    "src_5_modes",
    "conversations",
    f"""with s as (select conv_id, turn, {_SPEC} as spec from conversations)
    select conv_id, turn, case when turn % 6 in (2, 3) then 'id' when turn % 6 = 1 then 'category' when trim(coalesce(spec, '')) = '' then 'default' else 'keyword' end as mode,
           case turn % 6 when 2 then 'math/0211159v1,2401.12345v2' when 3 then 'cs.AI/0001001' else '' end as ids from s""",
)
def src_5(c: DataFrame) -> DataFrame:
    """Each turn's text, or one of five specs, as what a feed asks for."""
    spec = F.expr(_SPEC)
    return c.select("conv_id", "turn", T.source_mode(spec).alias("mode"), F.array_join(T.source_ids(spec), ",").alias("ids"))


@over_tables("vec_8_expected_strings", "documents benchmark", "select item_id, count(*) as hits from benchmark b join documents d on contains(lower(d.text), lower(b.text)) group by item_id")
def vec_8(d: DataFrame, b: DataFrame) -> DataFrame:
    hits = R.expected_hits(d.select(F.col("doc_id").alias("text_id"), "text"), b.select("item_id", "text"))
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"))


@over_tables(
    "vec_8_question_hits",
    "conversations",
    """with w as (select conv_id as qid, string_split(arg_min(coalesce(text, ''), turn), ' ')[1] as word from conversations group by conv_id)
    select w.qid, case when any_value(word) = '' then count(c.turn) > 0 else coalesce(bool_or(contains(lower(coalesce(c.text, '')), lower(word))), false) end as hit
    from w left join conversations c on c.conv_id = w.qid and c.turn > 0 group by w.qid""",
)
def vec_8_questions(c: DataFrame) -> DataFrame:
    """The first word of each conversation is expected in its later turns."""
    word = F.get(F.split(F.min_by(F.coalesce("text", F.lit("")), "turn"), " "), F.lit(0))
    asked = c.groupBy(F.col("conv_id").alias("qid")).agg(word.alias("word")).select("qid", F.when(F.col("word") == "", F.array().cast("array<string>")).otherwise(F.array("word")).alias("expected"))
    return R.retrieval_hit(c.where("turn > 0").select(F.col("conv_id").alias("qid"), F.coalesce("text", F.lit("")).alias("text")), asked)


def _pick(i: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


@over_tables(
    "agg_14_confusion",
    "labels",
    """with p as (select ['graph', 'vector', 'hybrid'][doc_id % 3 + 1] as expected, ['graph', 'vector', 'hybrid', 'other'][(doc_id * 7 + quality) % 4 + 1] as predicted from labels),
    g as (select unnest(['graph', 'vector', 'hybrid']) as expected), h as (select unnest(['graph', 'vector', 'hybrid', 'other']) as predicted)
    select g.expected, h.predicted, (select count(*) from p where p.expected = g.expected and p.predicted = h.predicted) as n from g, h""",
)
def agg_14(x: DataFrame) -> DataFrame:
    pairs = x.select(_pick(F.col("doc_id") % 3, ["graph", "vector", "hybrid"]).alias("expected"), _pick((F.col("doc_id") * 7 + F.col("quality")) % 4, ["graph", "vector", "hybrid", "weird"]).alias("predicted"))
    return R.confusion(pairs, ["graph", "vector", "hybrid"])


@over_tables(
    "agg_17_prf",
    "labels",
    """with c as (
        select count(*) filter (quality = 1 and toxic = 0) as tp, count(*) filter (quality = 1 and toxic <> 0) as fp, count(*) filter (quality <> 1 and toxic = 0) as fn, count(*) filter (quality <> 1 and toxic <> 0) as tn from labels),
    r as (select *, tp / (tp + fp) as precision, tp / (tp + fn) as recall from c)
    select tp, fp, fn, tn, precision, recall, 2 * precision * recall / (precision + recall) as f1, (tp + tn) / (tp + fp + fn + tn) as accuracy from r""",
)
def agg_17(x: DataFrame) -> DataFrame:
    return R.prf(x.select((F.col("quality") == 1).alias("predicted"), (F.col("toxic") == 0).alias("actual")))


_VERDICTS = "with v as (select source as answer, doc_id as claim, quality = 1 as supported from labels join documents using (doc_id))"


def verdicts(x: DataFrame, d: DataFrame) -> DataFrame:
    """Each source as an answer, its labelled documents as claims, supported where the quality is 1."""
    return x.join(d.select("doc_id", "source"), "doc_id").select(F.col("source").alias("answer"), F.col("doc_id").alias("place"), F.col("doc_id").alias("claim"), (F.col("quality") == 1).alias("supported"))


@over_tables(
    "agg_16_faithfulness",
    "labels documents",
    _VERDICTS
    + """, p as (select answer, avg(supported::int) as s, count(*) filter (not supported) as bad, count(*) as n from v group by answer)
    select round(avg(s), 6) as mean, round(sum(bad) / sum(n), 6) as unsupported_rate, sum(n)::bigint as claims, count(*) filter (bad > 0) as answers_with_unsupported from p""",
)
def agg_16(x: DataFrame, d: DataFrame) -> DataFrame:
    return R.faithfulness(verdicts(x, d))


@over_tables(
    "agg_11_trust",
    "labels documents",
    _VERDICTS
    + """ select answer, round_even(avg(supported::int), 3) as score, count(*) as total, count(*) filter (supported) as supported,
    coalesce(array_to_string(list_slice(list(claim order by claim) filter (not supported), 1, 10), ','), '') as unsupported, array_to_string(list_slice(list(claim order by claim), 1, 16), ',') as claims from v group by answer""",
)
def agg_11(x: DataFrame, d: DataFrame) -> DataFrame:
    return R.trust(verdicts(x, d))


@over_tables(
    "agg_18_percentiles",
    "events",
    """with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events)
    select event_type, value from r where r = round_even(0.99::double * (n - 1), 0) + 1""",
)
def agg_18(e: DataFrame) -> DataFrame:
    return R.nearest_rank(e, "event_type", "value", 0.99)


@over_tables("win_2_last_turns", "conversations", "select conv_id, turn, role, text, count(*) over (partition by conv_id) as next_index from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 6")
def win_2(c: DataFrame) -> DataFrame:
    return R.last_turns(c.select("conv_id", "turn", "role", "text"))


@over_tables("win_3_aged_out", "conversations", "select conv_id, turn, lag(turn, 6) over (partition by conv_id order by turn) as aged from conversations")
def win_3(c: DataFrame) -> DataFrame:
    return R.aged_out(c.select("conv_id", "turn"))


@over_tables(
    "win_4_history",
    "conversations",
    """with r as (select conv_id, turn, coalesce(role, '') || ': ' || coalesce(text, '') as line from conversations),
    u as (select *, sum(length(line) + 1) over (partition by conv_id order by turn desc) as used, row_number() over (partition by conv_id order by turn desc) as k from r),
    k as (select conv_id, turn, case when used - 1 <= 1500 then line else substr(line, 1, 1499) || '…' end as line from u where used - 1 <= 1500 or k = 1)
    select conv_id, string_agg(line, chr(10) order by turn) as history from k group by conv_id""",
)
def win_4(c: DataFrame) -> DataFrame:
    return R.history_block(c, 1500)


_JOB = """with j as (
    select 'src_' || (user_id % 20) as source_id, 'doc_' || user_id as document_url, ts, event_id,
           case event_type when 'signup' then 'queued' when 'purchase' then 'success' when 'error' then 'failed' else 'running' end as status from events)"""
_STATE = """, s as (select source_id, document_url, case when count(*) filter (status = 'success') > 0 then 'success' else arg_max(status, {'t': ts, 'e': event_id}) end as status from j group by all)"""


def jobs_of(e: DataFrame) -> DataFrame:
    """Events as a job log: a document for each user, twenty sources."""
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind == "purchase", "success").when(kind == "error", "failed").otherwise("running")
    return e.select(F.concat(F.lit("src_"), (F.col("user_id") % 20).cast("string")).alias("source_id"), F.concat(F.lit("doc_"), F.col("user_id").cast("string")).alias("document_url"), status.alias("status"), "ts", "event_id")


@over_tables("agg_9_job_counts", "events", _JOB + " select source_id, count(*) as total, count(*) filter (status = 'success') as success, count(*) filter (status = 'failed') as failed, count(*) filter (status in ('queued', 'running')) as open from j group by source_id")
def agg_9(e: DataFrame) -> DataFrame:
    return R.job_counts(jobs_of(e))


@over_tables("agg_9_latest_jobs", "events", _JOB + " select source_id, event_id, status from j qualify row_number() over (partition by source_id order by ts desc, event_id desc) <= 50")
def agg_9_latest(e: DataFrame) -> DataFrame:
    return R.latest(jobs_of(e), "ts", 50, "source_id", "event_id").select("source_id", "event_id", "status")


@over_tables("str_2_job_states", "events", _JOB + _STATE + " select * from s")
def str_2(e: DataFrame) -> DataFrame:
    return R.job_states(jobs_of(e))


@over_tables(
    "agg_10_rollup",
    "events",
    _JOB
    + _STATE
    + """, c as (select source_id, count(*) as n, count(*) filter (status = 'success') as ok, count(*) filter (status in ('queued', 'running')) as open from s group by source_id)
    select source_id, case when open > 0 then 'unchanged' when ok = 0 then 'error' else 'success' end as status, case when open = 0 and ok = 0 then 'All ' || n || ' document(s) failed to ingest.' else '' end as error from c""",
)
def agg_10(e: DataFrame) -> DataFrame:
    return R.rollup_sources(R.job_states(jobs_of(e)))


@over_tables(
    "str_3_stuck",
    "events",
    _JOB
    + """, s as (select source_id, document_url, arg_max(status, {'t': ts, 'e': event_id}) as status, max(ts) as ts from j group by all)
    select source_id, document_url from s where status = 'running' and ts < (select max(ts) from events) - interval 15 minutes""",
)
def str_3(e: DataFrame) -> DataFrame:
    return R.stuck(jobs_of(e), F.lit(e.agg(F.max("ts")).first()[0]))


@over_tables("str_2_stream", "events", _JOB + _STATE + " select * from s")
def str_2_stream(e: DataFrame) -> DataFrame:
    """The job states again, by the stream's keyed state over the log written as a stream's folder."""
    log = stored(jobs_of(e).withColumn("ts", F.col("ts").cast("timestamp")), "job-log")
    return S.job_states_by_stream(J.table_stream(e.sparkSession, log.stored_at))


_WORKERS = """with k as (select 'worker-' || (user_id % 12) as worker_id, ts, event_id, user_id, case event_type when 'signup' then 'assign' when 'purchase' then 'complete' when 'error' then 'register' else 'heartbeat' end as kind from events),
    e as (select *, sum((kind in ('assign', 'register'))::int) over (partition by worker_id order by ts, event_id) as spell from k),
    a as (select worker_id, spell, arg_min(kind, event_id) filter (kind in ('assign', 'register')) = 'assign' as busy, max(event_id) filter (kind = 'assign') as id, max(user_id) filter (kind = 'assign') as u,
                 min(ts) filter (kind = 'complete' and event_id % 4 <> 0) as done from e group by all),
    h as (select e.worker_id, e.spell, e.ts, lead(e.ts) over (partition by e.worker_id order by e.ts, e.event_id) as next from e join a using (worker_id, spell) where kind <> 'complete' or (busy and event_id % 4 <> 0)),
    d as (select worker_id, spell, min(h.ts + interval 1 hour) as dead_at from h join a using (worker_id, spell) where busy and (done is null or h.ts < done) and coalesce(next, (select max(ts) from events)) - h.ts > interval 1 hour group by all)
    select worker_id, 'batch-' || id as batch_id, dead_at, 'doc-' || (u + x) as document_url from d join a using (worker_id, spell), (select unnest([0, 1]) as x)"""


def workers_of(e: DataFrame) -> DataFrame:
    """Events as a log of twelve workers: sign-ups assign a batch of two documents, errors register anew, all others but purchases are heartbeats. Purchases complete a batch; every fourth names another one."""
    kind = F.when(F.col("event_type") == "signup", "assign").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "register").otherwise("heartbeat")
    batch = F.when(F.col("event_type") == "signup", F.concat(F.lit("batch-"), F.col("event_id").cast("string")))
    docs = F.when(F.col("event_type") == "signup", F.array(*[F.concat(F.lit("doc-"), (F.col("user_id") + i).cast("string")) for i in (0, 1)]))
    return e.select(F.concat(F.lit("worker-"), (F.col("user_id") % 12).cast("string")).alias("worker_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"), batch.alias("batch_id"), docs.alias("docs"))


def completed(log: DataFrame) -> DataFrame:
    """The log in batch with the batches that completions name: their worker's last one, but for every fourth."""
    own = W.partitionBy("worker_id").orderBy("ts", "event_id")
    last = F.last("batch_id", ignorenulls=True).over(own)
    return log.withColumn("batch_id", F.when((F.col("kind") == "complete") & (F.col("event_id") % 4 != 0), last).when(F.col("kind") == "complete", F.lit("batch-of-another")).otherwise(F.col("batch_id")))


@over_tables("str_3_silent_workers", "events", _WORKERS)
def str_3_silent(e: DataFrame) -> DataFrame:
    return S.silent_workers_at(completed(workers_of(e)), F.lit(e.agg(F.max("ts")).first()[0]).cast("timestamp"), "1 hour")


@over_tables("str_3_silent_stream", "events", f"select * from ({_WORKERS}) where dead_at < (select max(ts) from events) - interval 2 hours")
def str_3_stream(e: DataFrame) -> DataFrame:
    """The same by event-time timers, over the log written as a stream's folder: what the watermark, two hours behind, has seen out."""
    log = stored(completed(workers_of(e)), "worker-log")
    return S.silent_workers_by_stream(J.table_stream(e.sparkSession, log.stored_at), "1 hour", "2 hours")


@over_tables("str_4_failures_by_hour", "events", "select date_trunc('hour', ts) as hour, count(*) as failures from events where event_type = 'error' group by all")
def str_4(e: DataFrame) -> DataFrame:
    return J.failures_by_hour(jobs_of(e))


_REPORT = "select conv_id * 1000 + turn as report_id, 'w' as ws, role as question, case when turn % 3 = 0 then null else 'u' || (conv_id % 5) end as user, conv_id as created_at from conversations"


def reports_of(c: DataFrame) -> DataFrame:
    return c.selectExpr("conv_id * 1000 + turn as report_id", "'w' as ws", "role as question", "case when turn % 3 = 0 then null else concat('u', conv_id % 5) end as user", "conv_id as created_at")


@over_tables(
    "win_1_versions",
    "conversations",
    f"""with r as ({_REPORT})
    select r.report_id, 1 + (select count(*) from r e where e.question is not distinct from r.question and (e.created_at, e.report_id) < (r.created_at, r.report_id) and (e.user is null or e.user = r.user)) as version from r""",
)
def win_1(c: DataFrame) -> DataFrame:
    return V.report_versions(reports_of(c)).select("report_id", "version")


@over_tables(
    "sink_6_appended",
    "conversations",
    f"""with r as ({_REPORT}),
    n as (select r.report_id, 1 + (select count(*) from r e where e.question is not distinct from r.question and (e.created_at, e.report_id) < (r.created_at, r.report_id) and (e.user is null or e.user = r.user)) as version from r)
    select report_id, version from n""",
)
def sink_6(c: DataFrame) -> DataFrame:
    """The reports of the later half of the conversations appended to those of the earlier one."""
    rows = reports_of(c)
    half = F.lit(c.agg(F.floor(F.max("conv_id") / 2)).first()[0])
    old = V.report_versions(rows.where(F.col("created_at") <= half))
    return V.append_reports(old, rows.where(F.col("created_at") > half)).select("report_id", "version")


@over_tables(
    "fil_7_visible",
    "conversations",
    """with r as (select conv_id * 1000 + turn as id, 'w' || (conv_id % 4) as ws, case when turn % 3 = 0 then null else 'u' || (conv_id % 5) end as user from conversations)
    select id as report_id from r where ws <> 'w3' and (ws = 'w1' or (ws = 'w0' and (user is null or user = 'u2')))""",
)
def fil_7(c: DataFrame) -> DataFrame:
    """What u2 sees: all of its own workspace w1, its own and anonymous ones of the shared w0, none of another's w2 and of the dismissed w3."""
    rows = c.selectExpr("conv_id * 1000 + turn as report_id", "concat('w', conv_id % 4) as ws", "case when turn % 3 = 0 then null else concat('u', conv_id % 5) end as user")
    spaces = c.select((F.col("conv_id") % 4).alias("i")).distinct().selectExpr("concat('w', i) as ws", "case when i = 1 then 'u2' when i = 2 then 'u3' end as owner")
    dismissed = spaces.where("ws = 'w3'").selectExpr("ws", "'u2' as user")
    return V.visible_reports(rows, spaces, dismissed, "u2").select("report_id")


@over_tables(
    "fil_8_candidate_names",
    "conversations",
    """with v as (select conv_id as qid, turn as row, 0 as pos, role as value from conversations union all select conv_id, turn, 1, substr(text, 1, 40) from conversations where text is not null),
    f as (select qid, value, min({'r': row, 'p': pos}) as seen from v where row < 40 and length(value) between 3 and 99 and not starts_with(value, 'http') and not (value = upper(value) and value <> lower(value)) group by all)
    select qid, value as name, row_number() over (partition by qid order by seen, value)::int as place from f qualify place <= 20""",
)
def fil_8(c: DataFrame) -> DataFrame:
    """Roles and the first 40 characters of texts as values of a question's rows."""
    two = F.array(F.struct(F.lit(0).alias("pos"), F.col("role").alias("value")), F.struct(F.lit(1).alias("pos"), F.substring("text", 1, 40).alias("value")))
    values = c.select(F.col("conv_id").alias("qid"), F.col("turn").alias("row"), F.explode(two).alias("v")).select("qid", "row", "v.pos", "v.value").where("value is not null")
    return V.candidate_names(values)


@over_tables(
    "agg_13_first_entities",
    "conversations",
    "select conv_id as qid, turn as pos, text as name from conversations where trim(text) <> '' qualify row_number() over (partition by conv_id, lower(trim(text)) order by turn) = 1",
)
def agg_13(c: DataFrame) -> DataFrame:
    return V.first_entities(c.selectExpr("conv_id as qid", "turn as pos", "text as name"))


@over_tables(
    "vec_10_routes",
    "labels",
    """with q as (select doc_id as qid, ['graph', 'vector', 'hybrid'][doc_id % 3 + 1] as route, quality = 1 and toxic = 0 as lacks from labels)
    select qid, route <> 'vector' or lacks as use_graph, route <> 'graph' or lacks as use_vector from q""",
)
def vec_10(x: DataFrame) -> DataFrame:
    route = _pick(F.col("doc_id") % 3, ["graph", "vector", "hybrid"])
    return V.effective_route(x.select(F.col("doc_id").alias("qid"), route.alias("route"), (F.col("quality") != 1).alias("forced"), F.col("toxic").alias("records"), F.lit(0).alias("stats"), F.col("toxic").alias("chunks")))
