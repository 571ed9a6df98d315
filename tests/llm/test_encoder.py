"""Cached encoding of whole texts equals the tokenizers library's own, and the pipeline's stages hold against brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kgspark.llm import decontaminate, nearjoin
from kgspark.llm.common import Encoder, chunks
from kgspark.llm.queries import tokenizer

TOK = Tokenizer.from_file(tokenizer())
TOK.encode_special_tokens = True
ENC, SMALL = Encoder(tokenizer()), Encoder(tokenizer(), keep=3)
PARTS = ["word", "don't", "Été", "é", "it's", "3.14", "a1b", "...", ".", "x.", "x;", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", "漢字", "ß.", "🙂", "<|endoftext|>", "#", "(y)", "z?!", "ª", "٠", "_", "\x00", "\x1c", "‍"]


def want(text):
    return np.array(TOK.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.lists(st.sampled_from(PARTS), max_size=12).map(" ".join) | st.text(max_size=20), max_size=5))
def test_cached_encoding_equals_direct_encoding(texts):
    assert ENC.encode(texts) == SMALL.encode(texts) == [want(t) for t in texts]


def test_cached_encoding_of_documents(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for some in chunks(texts, len, 50_000):
        assert ENC.encode(some) == [want(t) for t in some]


def test_chunks_keep_order_and_rows():
    assert [r for c in chunks(list(range(10)), lambda i: i, 7) for r in c] == list(range(10)) and list(chunks([], len)) == []


def test_pipeline_stages(spark):
    """Null, empty, repeated and contaminated rows, and a column of its own that every filtering stage keeps."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    odd = [(-1, None, None, None, None), (-2, "", "en", "a", 0), (-3, f"before {passage} after", "en", "a", 9), (None, "no id but a text of seven words", "en", "a", 5)]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).withColumn("shard", F.lit(1)).cache()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    _, near = corpus_pipeline.STAGES[1]
    got = near(spark, docs, sf).collect()
    rows = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    links, left, classes = nearjoin.brute_force(rows), set(rows), 0
    while left:
        todo, classes = [left.pop()], classes + 1
        while todo:
            new = links[todo.pop()] & left
            left -= new
            todo += new
    assert len(got) == classes + 1 and set(got[0].asDict()) == set(docs.columns)  # the row without an id is like no other

    _, clean = corpus_pipeline.STAGES[2]
    got = clean(spark, docs, sf)
    assert set(got.columns) == set(docs.columns)
    held = [r.doc_id for r in got.collect()]
    assert sorted(str(k) for k in held) == sorted(str(r.doc_id) for r in docs.collect() if not decontaminate.brute_force(r.text, items)[1])
    assert -3 not in held and {-1, -2, None} <= set(held)

    _, safe = corpus_pipeline.STAGES[0]
    got = safe(spark, docs, sf)
    assert set(got.columns) == set(docs.columns) and {-1, -2} <= {r.doc_id for r in got.collect()}
    _, pack = corpus_pipeline.STAGES[3]
    lengths = pack(spark, docs, sf).agg(F.sum("length")).first()[0]
    assert lengths == sum(len(want(r.text or "")) // 4 + 1 for r in docs.collect())
