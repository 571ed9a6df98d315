"""Token-id output: Arrow IPC files whose batches are fixed-size lists, one row for each sequence.

A file holds one range of the documents in ascending doc_id as one stream of ids, cut into rows of `length`
ids: `tokens` fixed_size_list<uint16 or uint32>[length] and `mask` fixed_size_list<bool>[length] (false where
the file's last row is padded). Memory-mapped, row i's ids are at a computed place: no parsing, no copies.
Beside it an index file has (doc_id, start, n_tokens), starts counted within the file. Both are written
under a hidden name and renamed, so that a task run again after a lost executor leaves one whole file.

Defined cases: null texts are empty and give the end id alone; repeated doc_ids are ordered by text, null
doc_ids come first; very long texts run over as many rows as they need; a range without rows has no file; an
empty table has no files; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import chunks, encoder, partitions, range_bounds, range_bucket, shared_dir, trimmed

LENGTH, ROWS = 2048, 256
MANIFEST = "part int, path string, n_docs long, n_tokens long, n_rows long"


def _store(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, per_batch: int = ROWS) -> DataFrame:
    """Writes the files to the shared folder; a row for each: part (in order of doc_id), path, n_docs, n_tokens, n_rows."""
    spark = docs.sparkSession
    folder, n = shared_dir(spark, "tokens"), partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = range_bounds(rows, "doc_id", n)
    dealt = rows.withColumn("part", range_bucket(F.col("doc_id"), bounds).cast("int")).repartitionById(len(bounds) + 1, "part")

    def run(batches: Iterator) -> Iterator:
        import os

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.ipc as ipc

        trimmed()
        enc = encoder(tokenizer)
        kind = np.uint16 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
        schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        end, state = np.array([end_id], "<u4").tobytes(), None

        def rows_of(ids: np.ndarray, mask: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], schema=schema)

        def closed() -> pa.RecordBatch:
            store, hidden, path, (f, writer), (g, idx), rest, docs_n, ids_n, n_rows = state
            if len(rest):
                mask = np.zeros(-(-len(rest) // length) * length, bool)
                mask[: len(rest)] = True
                writer.write_batch(rows_of(np.concatenate([rest, np.zeros(len(mask) - len(rest), kind)]), mask))
                n_rows += len(mask) // length
            for x in (writer, f, idx, g):
                x.close()
            for suffix in (".arrow", ".index"):
                store.move(hidden + suffix, path + suffix)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (f"{folder}/part-{part:06d}", pa.string()), (docs_n, pa.int64()), (ids_n, pa.int64()), (n_rows, pa.int64()))], ["part", "path", "n_docs", "n_tokens", "n_rows"])

        part = None
        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_pylist()
            for rows in chunks(list(range(batch.num_rows)), lambda i: size[i] + 50):
                some = batch.slice(rows[0], len(rows))
                keys = zip(some.column("part").to_pylist(), some.column("doc_id").to_pylist(), strict=True)
                for (p, doc), ids in zip(keys, enc.encode(some.column("text")), strict=True):
                    if p != part:
                        if state:
                            yield closed()
                        part = p
                        store, base = _store(folder)
                        store.create_dir(base, recursive=True)
                        path, hidden = f"{base}/part-{p:06d}", f"{base}/.part-{p:06d}-{os.urandom(8).hex()}"
                        f, g = store.open_output_stream(hidden + ".arrow"), store.open_output_stream(hidden + ".index")
                        state = [store, hidden, path, (f, ipc.new_file(f, schema)), (g, ipc.new_file(g, index)), np.zeros(0, kind), 0, 0, 0]
                        waiting, entries = [], []
                    one = np.frombuffer(ids + end, "<u4").astype(kind)
                    entries.append((doc, state[7], len(one)))
                    waiting.append(one)
                    state[6] += 1
                    state[7] += len(one)
                    if len(entries) >= 4096 or sum(map(len, waiting[-1:])) >= per_batch * length:
                        state[5] = np.concatenate([state[5], *waiting])
                        waiting = []
                    if len(entries) >= 4096:
                        state[4][1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*entries, strict=True)], schema=index))
                        entries = []
                state[5] = np.concatenate([state[5], *waiting])
                waiting = []
                if entries:
                    state[4][1].write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*entries, strict=True)], schema=index))
                    entries = []
                while len(state[5]) >= per_batch * length:
                    state[3][1].write_batch(rows_of(state[5][: per_batch * length], np.ones(per_batch * length, bool)))
                    state[5] = state[5][per_batch * length :]
                    state[8] += per_batch
        if state:
            yield closed()

    manifest = dealt.sortWithinPartitions("part", "doc_id", "text").mapInArrow(run, MANIFEST)
    at = f"{folder}-manifest"
    manifest.write.parquet(at)
    return spark.read.schema(MANIFEST).parquet(at)


def open_tokens(path: str, length: int = LENGTH):  # noqa: ANN202
    """(ids, mask, index) of one file: numpy views of the mapped batches for local stores, and the index table."""
    import pyarrow.ipc as ipc

    store, base = _store(path)
    opened = store.open_input_file(base + ".arrow") if store.type_name != "local" else __import__("pyarrow").memory_map(base + ".arrow")
    file = ipc.open_file(opened)
    batches = [file.get_batch(i) for i in range(file.num_record_batches)]
    ids = [b.column(0).flatten().to_numpy() for b in batches]
    masks = [b.column(1).flatten() for b in batches]
    return ids, masks, ipc.open_file(store.open_input_file(base + ".index")).read_all()


def read_documents(manifest: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "base")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts, masks, index = open_tokens(path, length)
                sizes = np.cumsum([0, *[int(m.true_count) for m in masks]])
                starts, counts = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                crcs = np.zeros(len(starts), np.int64)
                first = np.searchsorted(sizes, starts, side="right") - 1
                for k, (s, n, b) in enumerate(zip(starts.tolist(), counts.tolist(), first.tolist(), strict=True)):
                    crc = 0
                    while n > 0:
                        piece = parts[b][s - sizes[b] : s - sizes[b] + min(n, sizes[b + 1] - s)]
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        s, n, b = s + len(piece), n - len(piece), b + 1
                    crcs[k] = crc
                yield pa.RecordBatch.from_arrays([index["doc_id"].combine_chunks(), pa.array(starts + base), pa.array(counts), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
