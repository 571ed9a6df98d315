"""Benchmark decontamination: an Aho-Corasick automaton over normalised benchmark passages.

Each benchmark item gives its windows of `size` consecutive words (all its words if it has fewer). The automaton holds
every window, each word as a code of CODE characters, and scans the codes of each normalised text once; words that no
item has share one code. A match's place over CODE is a word place, so the words of a text that lie in any window's
occurrence are known at once, and are mapped back to code points of the original text.

The benchmark side goes to every task, so its size is bounded: items are dealt to blocks of about `block_bytes` of text (their
automaton takes some 150 MB), a task holds one block's automaton at a time, and one block does for any usual
benchmark, which is then built once for each worker. With more, a task builds each for 32 MB of texts. Blocks are broadcast in groups of at
most GROUP_BYTES of text, as that and not as windows; a benchmark of several groups takes a pass over the texts for each, from one written table to the next.

Defined cases: a null text or item has no words; an item without words has no window; a null item_id hits but is no item; repeated items
count once by item_id; an empty benchmark hits nothing; very long texts are scanned whole, very long items in overlapping pieces; an empty
table gives no rows; extra columns, whatever their names and types, are ignored by `contamination` and kept by `decontaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.common import chunks, unburdened, words_of, written

WINDOW, BLOCK_BYTES, GROUP_BYTES, PIECE = 10, 500_000, 32 << 20, 5_000
CODE = 3
NO_WORD = "\xff" * CODE
RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def pieces(benchmark: DataFrame, size: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """(item, norm): the distinct normalised items; one of more than `piece` words in pieces that share size - 1 words, so that each window is in one."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                got += [(item, b" ".join(words[i : i + piece + size - 1]).decode("utf-8", "surrogatepass")) for i in range(0, len(words), piece) if i == 0 or len(words) - i >= size]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], ["item", "norm"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, norm string").distinct()


@lru_cache(maxsize=1)
def _automaton(held: object, k: int, size: int):  # noqa: ANN202
    """(codes of words, automaton of their windows) of one block of items."""
    import ahocorasick

    codes: dict[bytes, str] = {}
    found: dict[str, list] = {}
    for item, norm in held.value[k]:
        words = []
        for w in norm.split(b" "):
            if w not in codes:
                codes[w] = len(codes).to_bytes(CODE, "big").decode("latin-1")  # the last code stands for all other words
            words.append(codes[w])
        for i in range(max(1, len(words) - size + 1)):
            found.setdefault("".join(words[i : i + size]), []).append(item)
    a = ahocorasick.Automaton()
    for w, items in found.items():
        a.add_word(w, (len(w) // CODE, items))
    if not found:
        return codes, None
    a.make_automaton()
    return codes, a


def _spans(text: str, hit: list[dict]) -> list[dict]:
    """Runs of hit words as code point spans of the original text."""
    at = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)] if hit else []
    return [{"start": at[h["start"]][0], "stop": at[h["stop"] - 1][1]} for h in hit]


def _runs(n: int, found: list[tuple[int, int]]) -> list[dict]:
    """The runs of words, of n, that lie in any of the found ranges."""
    import numpy as np

    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, [a for a, _ in found], 1)
    np.add.at(mark, [b for _, b in found], -1)
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(mark)[:n] > 0).view(np.int8), [0])))).tolist()
    return [{"start": a, "stop": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _pass(rows: DataFrame, blocks: list[list[tuple[str | None, bytes]]], size: int) -> DataFrame:
    """rows (row, text, ranges, items) with the hit ranges of words and the items of some blocks added, n_words and spans."""
    held, n_blocks = rows.sparkSession.sparkContext.broadcast(blocks), len(blocks)  # GROUP_BYTES of text at most
    schema = T.StructType([*rows.schema.fields[:4], T.StructField("n_words", T.LongType()), T.StructField("spans", RANGES)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        unburdened()
        for batch in batches:
            texts = batch.column(1)
            for at in chunks(list(range(batch.num_rows)), lambda i: texts[i].as_buffer().size + 50, 2_000_000 if n_blocks < 2 else 32_000_000):
                part = batch.slice(at[0], len(at))
                own = part.column(1).to_pylist()
                norms = [words_of(t) for t in own]
                ranges = [[(h["start"], h["stop"]) for h in x] for x in part.column(2).to_pylist()]
                items = [set(x) for x in part.column(3).to_pylist()]
                for k in range(n_blocks):
                    codes, a = _automaton(held, k, size)
                    for i, words in enumerate(norms if a else []):
                        for end, (n, whose) in a.iter("".join([codes.get(w, NO_WORD) for w in words])):
                            if (end + 1) % CODE == 0:
                                stop = (end + 1) // CODE
                                ranges[i].append((stop - n, stop))
                                items[i].update(whose)
                runs = [_runs(len(w), r) if r else [] for w, r in zip(norms, ranges, strict=True)]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                cols = [pa.array(runs, kind), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string())), pa.array([len(w) for w in norms], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols, pa.array([_spans(t, r) for t, r in zip(own, runs, strict=True)], kind)], schema.names)

    return rows.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, columns: list[str] | None = None, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """row (a struct of columns of docs, all by default), n_words, n_hit, items (sorted ids of items that occur), spans (hit passages in the original text)."""
    table = written(pieces(benchmark, size), "decontamination")
    total = table.agg(F.sum(F.octet_length("norm"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    at_once = max(1, group_bytes // block_bytes)
    block = F.pmod(F.xxhash64("item", "norm"), F.lit(n)).cast("int")
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if columns is None else columns)])
    rows = docs.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast(RANGES).alias("ranges"), F.array().cast("array<string>").alias("items"))
    for first in range(0, n, at_once):
        blocks: list[list] = [[] for _ in range(min(at_once, n - first))]
        for r in table.withColumn("k", block - first).where((F.col("k") >= 0) & (F.col("k") < at_once)).collect():  # about group_bytes
            blocks[r.k].append((r.item, r.norm.encode("utf-8", "surrogatepass")))
        got = _pass(rows, blocks, size)
        rows = written(got.select("row", "text", "ranges", "items"), "decontamination-pass") if first + at_once < n else got
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])
    return rows.select("row", "n_words", n_hit.alias("n_hit"), "items", "spans")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row for each document: words, hit words, items with occurring windows and their digest."""
    got = scan(docs, benchmark, ["doc_id"], size)
    return got.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark window."""
    return scan(docs, benchmark, None, size).where("n_hit = 0").select("row.*")


def brute_force(text: str | None, items: list[tuple[str, str | None]], size: int = WINDOW) -> tuple[int, int, list[str]]:
    """(n_words, n_hit, items) of one text by comparing every window at every place; for tests."""
    words, hit, found = words_of(text), set(), set()
    for item, passage in items:
        own = words_of(passage)
        for i in range(max(1, len(own) - size + 1) if own else 0):
            win = own[i : i + size]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(item)
    return len(words), len(hit), sorted(found)
