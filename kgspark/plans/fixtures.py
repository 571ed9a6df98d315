"""A property graph derived from the TPC-H-like tables, as claims, the append-only source of truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.plans.registry import table
from kgspark.store import unsent

CLAIM = ["ws", "source_id", "seq", "src_label", "src", "rel", "tgt_label", "tgt", "doc", "confidence"]


def _claims_of(rows: DataFrame, *made: Column) -> DataFrame:
    """The claims that each row makes: structs of (src_label, src, rel, tgt_label, tgt, confidence), null for none."""
    one = rows.select("ws", "source_id", F.col("seq").cast("long").alias("seq"), "doc", F.explode(F.array_compact(F.array(*made))).alias("c"))
    return one.select("ws", "source_id", "seq", "c.src_label", "c.src", "c.rel", "c.tgt_label", "c.tgt", "doc", "c.confidence")


def _claim_of(rows: DataFrame, made: Column) -> DataFrame:
    """One claim a row; a filter on its relation then drops the whole branch of the union."""
    one = rows.select("ws", "source_id", F.col("seq").cast("long").alias("seq"), "doc", made.alias("c"))
    return one.select("ws", "source_id", "seq", "c.src_label", "c.src", "c.rel", "c.tgt_label", "c.tgt", "doc", "c.confidence")


def _made(src_label: str, src: Column, rel: Column | str, tgt_label: str, tgt: Column, confidence: Column | float) -> Column:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = {"src_label": F.lit(src_label), "src": src, "rel": column(rel), "tgt_label": F.lit(tgt_label), "tgt": tgt, "confidence": column(confidence).cast("double")}
    return F.struct(*[v.alias(k) for k, v in fields.items()])


LINES_AT_ONCE = 8 << 20  # bytes of the lines' files that one task makes claims of


SENT_UP_TO = 64 << 20  # bytes of the lines' files beyond which no join of the claims broadcasts


def _dealt(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    """Two functions. One deals rows by a key to as many tasks as large tables need. Claims are aggregated in the tasks that make them, so the memory of one must not grow with the tables; small ones are left to Spark. The other keeps rows from being broadcast by joins of large tables, whose filtered rows are few bytes as files and many in the driver."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/lineitem.parquet")
    n = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(at).getLength()
    return lambda rows, key: rows.repartition(n // LINES_AT_ONCE, key) if n // LINES_AT_ONCE > spark.sparkContext.defaultParallelism else rows, lambda rows: unsent(rows) if n > SENT_UP_TO else rows


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is read once for all of its claims; what makes one claim a row is a branch of the union, so that filters on relations drop branches."""
    dealt, kept = _dealt(spark, sf_dir)
    customer, orders = table(spark, sf_dir, "customer"), dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"), "o_custkey")
    ws = F.concat(F.lit("ws_"), F.lower("c_mktsegment")).alias("ws")
    order = lambda k: F.concat(F.lit("order-"), F.col(k).cast("string"))
    o = orders.join(kept(customer), F.col("o_custkey") == F.col("c_custkey")).select(
        ws, F.concat(F.lit("src_"), (F.col("o_orderkey") % 7).cast("string")).alias("source_id"), F.col("o_orderkey").alias("seq"),
        order("o_orderkey").alias("doc"), "c_name", "o_orderpriority", "o_custkey", "o_orderdate", "o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_discount")
    l = dealt(lines, "l_orderkey").join(kept(dealt(o.select("ws", "source_id", "seq", "doc", "o_orderkey"), "o_orderkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    co = l.where("l_linenumber = 1").join(kept(supplier), F.col("l_suppkey") == F.col("s_suppkey")).select("ws", "source_id", "seq", "doc", "s_name").distinct()
    part, paper = F.concat(F.lit("part-"), F.col("l_partkey").cast("string")), F.col("doc")
    kind = F.when(F.col("l_returnflag") == "N", "SUPPORTS").when(F.col("l_returnflag") == "R", "CONTRADICTS").otherwise("RELATED_TO")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    home = customer.select(ws, F.lit("src_0").alias("source_id"), F.lit(-1).alias("seq"), F.concat(F.lit("customer-"), F.col("c_custkey").cast("string")).alias("doc"), "c_name", "c_nationkey")
    cited = F.when(F.col("_before").isNotNull(), _made("Paper", paper, "CITED", "Paper", order("_before"), 0.95))
    parts = [
        _claims_of(o.withColumn("_before", before), _made("Person", F.col("c_name"), "AUTHORED", "Paper", paper, 1.0), _made("Paper", paper, "ABOUT", "Topic", F.col("o_orderpriority"), 1.0), cited),
        _claim_of(co, _made("Person", F.col("s_name"), "AUTHORED", "Paper", paper, 1.0)),
        _claim_of(l, _made("Paper", paper, "MENTIONS", "Concept", part, 0.9)),
        _claim_of(l, _made("Concept", part, kind, "Organization", F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")), 1 - F.col("l_discount"))),
        _claim_of(home, _made("Person", F.col("c_name"), "AFFILIATED_WITH", "Organization", F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")), 1.0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*CLAIM)


#: The same claims, merged edges and nodes for DuckDB; a prefix of oracle queries.
KG_SQL = """
with o as (select 'ws_' || lower(c_mktsegment) as ws, 'src_' || (o_orderkey % 7) as source_id, o_orderkey as seq, 'order-' || o_orderkey as doc, c_name, o_orderpriority, o_custkey, o_orderdate
           from orders join customer on o_custkey = c_custkey),
l as (select o.*, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_discount from lineitem join o on l_orderkey = o.seq),
claims as (
  select ws, source_id, seq, 'Person' as src_label, c_name as src, 'AUTHORED' as rel, 'Paper' as tgt_label, doc as tgt, doc, 1.0::double as confidence from o
  union all select distinct ws, source_id, seq, 'Person', s_name, 'AUTHORED', 'Paper', doc, doc, 1.0 from l join supplier on l_suppkey = s_suppkey where l_linenumber = 1
  union all select ws, source_id, seq, 'Paper', doc, 'ABOUT', 'Topic', o_orderpriority, doc, 1.0 from o
  union all select ws, source_id, seq, 'Paper', doc, 'MENTIONS', 'Concept', 'part-' || l_partkey, doc, 0.9 from l
  union all select ws, source_id, seq, 'Concept', 'part-' || l_partkey, case l_returnflag when 'N' then 'SUPPORTS' when 'R' then 'CONTRADICTS' else 'RELATED_TO' end, 'Organization', 'supplier-' || l_suppkey, doc, 1 - l_discount from l
  union all select ws, source_id, seq, 'Paper', doc, 'CITED', 'Paper', 'order-' || b, doc, 0.95 from (select *, lag(seq) over (partition by o_custkey order by o_orderdate, seq) as b from o) where b is not null
  union all select 'ws_' || lower(c_mktsegment), 'src_0', -1, 'Person', c_name, 'AFFILIATED_WITH', 'Organization', 'nation-' || c_nationkey, 'customer-' || c_custkey, 1.0 from customer),
edges as (select ws, src_label, src, rel, tgt_label, tgt, arg_min(doc, {'a': seq, 'b': -confidence, 'c': doc}) as doc, arg_min(confidence, {'a': seq, 'b': -confidence, 'c': doc}) as confidence,
                 string_agg(distinct source_id, ',' order by source_id) as source_ids, count(distinct source_id) as source_count from claims group by all),
nodes as (select ws, label, name, string_agg(distinct source_id, ',' order by source_id) as source_ids, count(distinct source_id) as source_count
          from (select ws, src_label as label, src as name, source_id from claims union all select ws, tgt_label, tgt, source_id from claims) group by all)
"""
