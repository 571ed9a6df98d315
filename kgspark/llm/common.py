"""What the training-data operators share: words, shared folders, ordered buckets, cached encoding.

Words: A-Z are lower-cased, then runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` are taken, so every
non-ASCII code point is part of a word. A null text counts as empty everywhere.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.store import forget, shared_folder, stored

__all__ = ["Encoder", "chunks", "encoder", "forget", "partitions", "range_bounds", "range_bucket", "shared_dir", "trimmed", "unburdened", "words_col", "words_of", "written"]

shared_dir, written = shared_folder, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Byte map of the same rule: separators become spaces, A-Z lower case, the rest stays.
WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The UTF-8 words of one text (helper inside tasks)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def lower_az(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_col(text: Column) -> Column:
    """array<string> of words, empty for null or wordless texts."""
    return F.array_remove(F.split(lower_az(text), NOT_WORD), "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cuts of a long column into ranges of nearly equal row counts, from one pass over that column alone."""
    if n < 2:
        return []
    got = df.select(F.percentile_approx(F.col(key), [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0]
    return sorted(set(got or []))


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are below key, as a balanced tree of comparisons; 0 for null. Bucket i + 1 holds keys above bucket i's."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(key.isNull(), F.lit(0)).otherwise(tree(0, len(bounds)))


class Encoder:
    """Whole-text encoding by the tokenizers library, with the ids of space-separated pieces kept between texts.

    A byte-level pattern of the kind used here always starts a new pre-token at a single space or
    newline between other characters, so the ids of a text are those of its pieces in turn, and a stop after
    letters alone is a pre-token of its own. A text with any other white space next to such a cut is encoded in one
    call. Pieces and their ids are kept as Arrow and numpy arrays; when more than `keep` are held, those of the
    last call alone stay.
    """

    def __init__(self, path: str, keep: int = 400_000, longest: int = 64):
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.keep, self.longest = keep, longest
        stops = [(c, np.frombuffer(i, "<u4")) for c, i in zip(".,;:!?", self._ids(list(".,;:!?")), strict=True)]
        self.stops = pa.array([c for c, i in stops if len(i) == 1], pa.string())
        self.stop_ids = np.array([i[0] for _, i in stops if len(i) == 1], np.int64)
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, bool)  # where a token begins with a space
        for token, i in vocab.items():
            self.starts[i] = token[:1] == "\u0120"
        self.keys, self.size, self.odd, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.uint32)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, texts: list[str]):  # noqa: ANN202
        """(sizes, ids end to end) of texts encoded one by one."""
        import numpy as np

        parts = self._ids(texts)
        return np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts)), np.frombuffer(b"".join(parts), "<u4")

    def _letters(self, words: list[str]):  # noqa: ANN202
        """The same for words of letters alone that follow a space: joined by spaces each is one pre-token, so one call does for all of them."""
        import numpy as np

        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        ids = np.frombuffer(self._ids([" " + " ".join(words)])[0], "<u4")
        at = np.flatnonzero(self.starts[ids])
        return (np.diff(at, append=len(ids)), ids) if len(at) == len(words) else self._each([" " + w for w in words])

    @staticmethod
    def _cut_safe(piece: str) -> bool:
        body = piece[1:] if piece[:1] == "\n" else piece
        return bool(body) and not body[0].isspace() and not body[-1].isspace()

    def _held(self, pieces):  # noqa: ANN001, ANN202
        """(first, size, odd, flat): where in flat the ids are of distinct pieces that follow a space or newline; odd if one can't be cut out safely."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.index_in(pieces, value_set=self.keys)
        missing = pc.is_null(found)
        plain = pc.and_(missing, pc.utf8_is_alpha(pieces))
        other = pc.and_not(missing, plain)
        words, rest = pieces.filter(plain), pieces.filter(other)
        texts = rest.to_pylist()
        safe = np.array([self._cut_safe(p) for p in texts], bool)
        word_size, word_ids = self._letters(words.to_pylist())
        rest_size = np.zeros(len(texts), np.int64)
        rest_size[safe], rest_ids = self._each([p if p[0] == "\n" else " " + p for p, ok in zip(texts, safe.tolist(), strict=True) if ok])
        at = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        held = len(self.keys)
        at[plain.to_numpy(zero_copy_only=False)] = held + np.arange(len(words))
        at[other.to_numpy(zero_copy_only=False)] = held + len(words) + np.arange(len(rest))
        keys = pa.concat_arrays([self.keys, words, rest])
        size = np.concatenate([self.size, word_size, rest_size])
        odd = np.concatenate([self.odd, np.zeros(len(words), bool), ~safe])
        flat = np.concatenate([self.flat, word_ids, rest_ids])
        stay = pc.less_equal(pc.binary_length(keys), self.longest).to_numpy(zero_copy_only=False)
        if len(keys) > self.keep:
            used = np.zeros(len(keys), bool)
            used[at] = True
            stay = stay & used
        self.keys, self.size, self.odd, self.flat = keys.filter(pa.array(stay)), size[stay], odd[stay], flat[np.repeat(stay, size)]
        return (np.cumsum(size) - size)[at], size[at], odd[at], flat

    def encode(self, texts) -> list[bytes]:  # noqa: ANN001
        """Ids of each text of a list or Arrow array, as little-endian unsigned 32-bit bytes."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(texts):
            return []
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(col, "\n", " \n"), " ")
        edge = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.values.dictionary_encode()
        at, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.string())
        stop = pc.index_in(pc.utf8_slice_codeunits(pieces, -1), value_set=self.stops)
        bare = pc.if_else(pc.is_valid(stop), pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        plain = pc.utf8_is_alpha(bare)
        stopped = pc.and_(plain, pc.is_valid(stop)).to_numpy(zero_copy_only=False)
        keys = pc.if_else(plain, bare, pieces).dictionary_encode()
        first, size, odd, flat = (x if i == 3 else x[keys.indices.to_numpy()] for i, x in enumerate(self._held(keys.dictionary)))

        heads = pieces.take(pa.array(at[edge[:-1]])).to_pylist()
        at[edge[:-1]] = np.arange(len(heads)) + len(pieces)  # a text's first piece follows no space
        head_size, head_ids = self._each(heads)
        first = np.concatenate([first, len(flat) + np.cumsum(head_size) - head_size])
        size = np.concatenate([size + stopped, head_size])
        odd = np.concatenate([odd, np.array([not (h[:1] != "\n" and self._cut_safe(h)) for h in heads], bool)])
        tail = np.concatenate([np.where(stopped, self.stop_ids[stop.fill_null(0).to_numpy(zero_copy_only=False)], -1), np.full(len(heads), -1)])
        flat = np.concatenate([flat, head_ids, np.zeros(1, np.uint32)])

        alone = np.add.reduceat(odd[at].astype(np.int64), edge[:-1]) > 0
        n = size[at]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[at] - (ends - n), n) + np.arange(int(ends[-1]))]
        tail = tail[at]
        ids[ends[tail >= 0] - 1] = tail[tail >= 0]
        stops = np.concatenate(([0], ends))[edge].tolist()
        return [self._ids([col[i].as_py()])[0] if one else ids[x:y].tobytes() for i, (one, x, y) in enumerate(zip(alone.tolist(), stops, stops[1:], strict=False))]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, so that later tasks find its cache warm."""
    return Encoder(path)


def unburdened() -> None:
    """Drops what earlier operators' tasks left in this worker: encoder caches and unused memory."""
    encoder.cache_clear()
    trimmed()


def trimmed() -> None:
    """Gives unused memory of this worker back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(rows: list, size_of, most: int = 8_000_000):
    """Consecutive runs of rows of about `most` size units, to bound what a task holds at once."""
    run, held = [], 0
    for r in rows:
        run.append(r)
        held += size_of(r)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run
