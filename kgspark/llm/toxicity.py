"""Toxicity: a convolutional text classifier trained in numpy, with decision thresholds by language.

Words are hashed into `buckets` embeddings; filters of several widths slide over a text's words, each keeps its
greatest activation over the whole text, and a logistic layer gives the score. Only the text goes into a score.
As a filter is a sum of one matrix product for each of its words, scoring looks up products that were
computed once for each bucket, so that long texts cost a few additions a word.

Training takes about `per_class` labelled documents of each class and `most_bytes` of their text at most (documented bounds, chosen by a hash of doc_id
among the training rows) to the driver, as word buckets; everything else runs on executors over all rows. A fifth of the labelled training documents, by another hash,
is never fitted but sets the thresholds: a language's is the score, to a thousandth, that best splits all of its rows in that fifth (balanced
accuracy, the nearest to 0.5 of equal ones); a language with fewer than 40 of them takes 0.5.

Defined cases: null texts and texts without words score as no words at all; conflicting labels of a document count as toxic;
of repeated doc_ids the least text is fitted; null labels are ignored; without both classes to learn from, every score is 0; null or unknown languages have threshold
0.5; repeated rows score alike; very long texts are read whole; an empty table gives no rows; extra columns are ignored, and kept by `clean`. Words in fewer than `LEAST` of the fitted texts are
neutral, so a toxic word that is rarer than that, as in a small language, is not learnt.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.llm.common import chunks, unburdened, words_of

BUCKETS, WIDTHS, FILTERS, DIM = 1 << 15, (1, 2, 3), 8, 12
PER_CLASS, MOST_BYTES, LEAST, BINS, FLOOR = 4_000, 32 << 20, 16, 1000, 0.25


def hashed(texts: list[str], cache: dict, buckets: int = BUCKETS):  # noqa: ANN201
    """(bucket of each word of all texts, first place of each text); each text has max(WIDTHS) words of padding (bucket 0) behind it."""
    import numpy as np

    pad, ids, starts = [0] * max(WIDTHS), [], []
    for t in texts:
        starts.append(len(ids))
        words = words_of(t)
        for w in set(words).difference(cache):
            cache[w] = zlib.crc32(w) % (buckets - 1) + 1
        ids += map(cache.__getitem__, words)
        ids += pad
    if len(cache) > 100_000:
        cache.clear()
    return np.array(ids, np.int32), np.array(starts, np.int64)


def _crossing(starts, n: int, width: int):  # noqa: ANN001, ANN202
    """Places, of n, whose window of `width` words would reach into the next text."""
    import numpy as np

    stops = np.append(starts[1:], n)
    return (stops[:, None] - np.arange(1, width)).ravel()


@dataclass
class Model:
    tables: list = field(default_factory=list)  # for each width, a (width, buckets, filters) array of products
    bias: list = field(default_factory=list)
    out: object = None
    out_bias: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def scores(self, ids, starts):  # noqa: ANN001, ANN201
        import numpy as np

        if self.out is None or not len(starts):
            return np.zeros(len(starts))
        pooled = []
        for w, table, bias in zip(WIDTHS, self.tables, self.bias, strict=True):
            conv = table[0][ids]
            for k in range(1, w):
                conv[:-k] += table[k][ids[k:]]
            conv[_crossing(starts, len(ids), w)] = -np.inf
            pooled.append(np.maximum(np.maximum.reduceat(conv, starts, axis=0) + bias, 0))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(pooled, 1) @ self.out + self.out_bias, -30, 30)))


def fit(words: list, labels: list[int], prior: float = 0.5, epochs: int = 10, rate: float = 0.01, least: int = LEAST, seed: int = 7) -> Model:
    """Adam on the class-balanced logistic loss; the gradient of a pooled filter reaches the words of its greatest window.

    words: the buckets of each text's words, with padding. Buckets in fewer than `least` of the texts are left neutral, so that no text is learnt by heart. prior: the share of toxic
    rows among all training rows, to which the scores are moved back.
    """
    import numpy as np

    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model()
    rng, ids = np.random.default_rng(seed), np.concatenate(words)
    stops = np.cumsum([len(w) for w in words])
    starts = stops - [len(w) for w in words]
    seen = np.zeros(BUCKETS, np.int64)
    for a, b in zip(starts, stops, strict=True):
        seen[np.unique(ids[a:b])] += 1
    rare = seen < least
    ids = np.where(rare[ids], 0, ids)
    p = {"e": rng.normal(0, 0.1, (BUCKETS, DIM)), "o": rng.normal(0, 0.3, len(WIDTHS) * FILTERS), "ob": np.zeros(1)}
    p["e"][0] = 0
    for w in WIDTHS:
        p[f"w{w}"], p[f"b{w}"] = rng.normal(0, 0.4, (w, DIM, FILTERS)), np.zeros(FILTERS)
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(max(epochs, 50_000 // len(y))):
        order = rng.permutation(len(y))
        for rows in np.array_split(order, max(1, len(order) // 128)):
            own = np.concatenate([ids[starts[r] : stops[r]] for r in rows])
            first = np.cumsum([0, *[stops[r] - starts[r] for r in rows]])[:-1]
            used, at = np.unique(own, return_inverse=True)
            emb = p["e"][used]
            pooled, best = [], []
            for w in WIDTHS:
                tab = np.einsum("ud,kdf->kuf", emb, p[f"w{w}"])
                conv = tab[0][at]
                for k in range(1, w):
                    conv[:-k] += tab[k][at[k:]]
                conv[_crossing(first, len(own), w)] = -np.inf
                top = np.maximum.reduceat(conv, first, axis=0)
                lens = np.diff(np.append(first, len(own)))
                hit = conv == np.repeat(top, lens, axis=0)
                where = np.minimum.reduceat(np.where(hit, np.arange(len(own))[:, None], len(own)), first, axis=0)
                best.append(where)
                pooled.append(np.maximum(top + p[f"b{w}"], 0))
            h = np.concatenate(pooled, 1)
            s = 1 / (1 + np.exp(-np.clip(h @ p["o"] + p["ob"][0], -30, 30)))
            d = (s - y[rows]) * weight[rows] / len(rows)
            g = {"o": h.T @ d + 1e-4 * p["o"], "ob": np.array([d.sum()])}
            dh = d[:, None] * p["o"] * (h > 0)
            ge = np.zeros_like(emb)
            for i, w in enumerate(WIDTHS):
                part, where = dh[:, i * FILTERS : (i + 1) * FILTERS], best[i]
                g[f"b{w}"], g[f"w{w}"] = part.sum(0), np.zeros((w, DIM, FILTERS))
                for k in range(w):
                    word = at[np.minimum(where + k, len(at) - 1)]  # (rows, filters)
                    for f in range(FILTERS):
                        g[f"w{w}"][k, :, f] = emb[word[:, f]].T @ part[:, f]
                        np.add.at(ge, word[:, f], part[:, f : f + 1] * p[f"w{w}"][k, :, f])
            t += 1
            for k, grad in g.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
            live = used != 0
            u, grad = used[live], ge[live] + 1e-4 * emb[live]
            m["e"][u], v["e"][u] = 0.9 * m["e"][u] + 0.1 * grad, 0.999 * v["e"][u] + 0.001 * grad * grad
            p["e"][u] -= rate * (m["e"][u] / (1 - 0.9**t)) / (np.sqrt(v["e"][u] / (1 - 0.999**t)) + 1e-8)
    p["e"][rare] = 0
    tables = [np.ascontiguousarray(np.einsum("ud,kdf->kuf", p["e"], p[f"w{w}"]), np.float32) for w in WIDTHS]
    return Model(tables, [p[f"b{w}"].astype(np.float32) for w in WIDTHS], p["o"].astype(np.float32), float(p["ob"][0] + np.log(prior / (1 - prior))))


def threshold(clean: list[int], toxic: list[int]) -> float:
    """The cut of best balanced accuracy, nearest to 0.5 of equal ones, from counts by score bin; 0.5 when a class is missing."""
    import numpy as np

    c, t = np.asarray(clean, float), np.asarray(toxic, float)
    if not c.sum() or not t.sum():
        return 0.5
    good = np.concatenate(([0], np.cumsum(c))) / c.sum() + 1 - np.concatenate(([0], np.cumsum(t))) / t.sum()
    cuts = np.flatnonzero(good >= good.max() - 1e-12) / len(c)
    return float(cuts[np.argmin(np.abs(cuts - 0.5))])


def _marks(labels: DataFrame, training: Column | None) -> DataFrame:
    """(doc_id, _toxic) of training labels."""
    use = training if training is not None else F.lit(True)
    return labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(use).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))


def _calibrates() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(5)) == 0


def _hashed_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, _toxic, ids): word buckets of the texts of rows, two bytes each."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        cache: dict = {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, starts = hashed(texts, cache)
            stops = np.append(starts[1:], len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([ids[a:b].astype("<u2").tobytes() for a, b in zip(starts, stops, strict=True)], pa.binary())], ["doc_id", "_toxic", "ids"])

    return rows.select("doc_id", "text", "_toxic").mapInArrow(run, "doc_id long, _toxic int, ids binary")


def train(docs: DataFrame, labels: DataFrame, training: Column | None = None, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES) -> Model:
    """Fits a model and its thresholds. training: which doc_ids may be learnt from (all by default)."""
    import numpy as np

    marks = _marks(labels, training)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    marked = rows.select("doc_id", F.octet_length("text").alias("size")).join(marks, "doc_id")  # texts are never shuffled
    sizes = {r["_toxic"]: (r.n, r.size) for r in marked.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect()}
    if len(sizes) < 2:
        return Model()
    share = F.lit(1.0)
    for k, n in {r["_toxic"]: r["count"] for r in marks.groupBy("_toxic").count().collect()}.items():
        mean = sizes[k][1] / sizes[k][0] if k in sizes else 0
        share = F.when(F.col("_toxic") == k, F.lit(min(1.0, per_class / n, most_bytes / max(1.0, mean * n)))).otherwise(share)
    spread = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = F.broadcast(marks.where(~_calibrates() & (spread < share)))  # about per_class rows a class
    chosen = rows.join(few, "doc_id").groupBy("doc_id").agg(F.max("_toxic").alias("_toxic"), F.min("text").alias("text"))
    got = sorted((r.doc_id, r.ids, r["_toxic"]) for r in _hashed_rows(chosen).collect())  # and most_bytes of text
    prior = sum(n for k, (n, _) in sizes.items() if k) / sum(n for n, _ in sizes.values())
    model = fit([np.frombuffer(g[1], "<u2").astype(np.int32) for g in got], [g[2] for g in got], prior)
    if model.out is None:
        return model
    bins = scored(rows.where(_calibrates()), model, ["doc_id", "lang"]).select("row.doc_id", "row.lang", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    bins = bins.join(marks, "doc_id").groupBy("lang", "_toxic", "bin").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[str, list] = {}
    for r in bins.where("lang <> ''").collect():  # 2 * BINS rows a language at most
        counts.setdefault(r.lang, [[0] * BINS, [0] * BINS])[r["_toxic"] != 0][r.bin] = r.n
    model.thresholds = {lang: threshold(*c) for lang, c in counts.items() if sum(map(sum, c)) >= 40}
    return model


def scored(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """row (a struct of columns of docs), score, threshold (of the row's language)."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"), docs["lang"].cast("string").alias("lang"))
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * FILTERS * sum(WIDTHS) floats: 6 MB

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        unburdened()
        m, cache = held.value, {}
        for batch in batches:
            texts = batch.column(1)
            for at in chunks(list(range(batch.num_rows)), lambda i: texts[i].as_buffer().size + 50, 2_000_000):
                part = batch.slice(at[0], len(at))
                score = m.scores(*hashed(part.column(1).to_pylist(), cache)).astype(np.float64)
                cuts = [m.thresholds.get(x, 0.5) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(cuts, pa.float64())], ["row", "score", "threshold"])

    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted (at 0.5), threshold and flagged (by language) for every row."""
    got = scored(docs, train(docs, labels, ~held_out), ["doc_id"]).select("row.doc_id", "score", "threshold")
    return got.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"),
    )


def clean(docs: DataFrame, labels: DataFrame, floor: float = FLOOR) -> DataFrame:
    """The rows of docs, with all their columns, that score below both 0.5 and their language's threshold. A threshold below `floor` counts as `floor`: a language with few toxic texts can have a
    calibrated cut that rests on one of them, and clean texts are to stay."""
    got = scored(docs, train(docs, labels), docs.columns)
    return got.where((F.col("score") < 0.5) & (F.col("score") < F.greatest("threshold", F.lit(floor)))).select("row.*")
