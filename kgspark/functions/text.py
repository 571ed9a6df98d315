"""Scalar and array functions over texts, names and vectors, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOB_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the URL namespace of RFC 4122
#: The clauses of the public openCypher manual that write, load or call; white space in one stands for any.
WRITE_CLAUSES = ("CREATE", "MERGE", "SET", "DELETE", "DETACH", "REMOVE", "FOREACH", "LOAD CSV", "CALL", "DROP")
SMALL, CAPITAL, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: IPv4 blocks that are private, loopback, link-local, documentation, benchmarking, multicast, reserved or unspecified (RFC 6890 and its successors).
INNER_IPV4 = (
    r"^(?:0|10|127)\.|^169\.254\.|^172\.(?:1[6-9]|2\d|3[01])\.|^192\.168\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^(?:22[4-9]|23\d|24\d|25[0-5])\."
)
#: The public part of IPv6 is 2000::/3 without 2001::/23, 2001:db8::/32, 2002::/16 and 3fff::/20.
PUBLIC_IPV6, INNER_IPV6 = r"^[23][0-9a-f]{3}:", r"^(?:2001:(?:0*[01]?[0-9a-f]{0,2}|0?db8):|2002:|3fff:0?[0-9a-f]{0,3}:)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_words(text: Column, size: int = 400, overlap: int = 40) -> Column:
    """Windows of `size` words every size - overlap; a text of at most `size` words is its own, unchanged. Words are split at any Unicode white space."""
    step = size - overlap

    def cut(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))
        return F.when(n <= size, F.array(text)).otherwise(parts)

    return let(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), cut)


def char_windows(text: Column, size: int = 6000, overlap: int = 600, most: int | None = None) -> Column:
    """Windows of `size` characters every size - overlap while one starts inside the text, at most `most`; a text of at most `size` is whole."""
    n, step = F.char_length(text), size - overlap
    last = F.ceil(n / F.lit(step)) - 1
    last = (F.least(F.lit(most - 1), last) if most else last).cast("int")
    return F.when(n <= size, F.array(text)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size))))


def document_body(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", title).otherwise(F.concat(title, F.lit(". "), text))


def doc_id_of(name: Column) -> Column:
    return F.substring(F.sha2(name, 256), 1, 16)


def bucket_of(name: Column, n: int) -> Column:
    """sha256(lower(trim(name))) as one number, modulo n."""
    digest = F.sha2(F.lower(F.trim(name)), 256)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, x: (acc * F.lit(4294967296) + x) % n)


def job_id(source: Column, url: Column) -> Column:
    """The name-based UUID (version 5) of `source:url`."""
    h = F.sha1(F.concat(F.unhex(F.lit(JOB_NAMESPACE)), F.concat_ws(":", source, url).cast("binary")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(63)).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def trim_answer(text: Column, limit: int = 600) -> Column:
    """White space collapsed; beyond the limit cut at the last space if that is past 60 % of it, with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring(flat, 1, limit)
    at = F.lit(limit) - F.instr(F.reverse(cut), " ")
    short = F.when((F.instr(F.reverse(cut), " ") > 0) & (at > limit * 0.6), F.substring(cut, F.lit(1), at.cast("int"))).otherwise(cut)
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-10))


def band(similarity: Column, low: float, high: float) -> Column:
    return F.when(similarity >= high, "merge").when(similarity < low, "new").otherwise("borderline")


def is_read_only(query: Column) -> Column:
    """Neither blank nor holding a writing clause as words, in any case."""
    clauses = "|".join(c.replace(" ", r"\s+") for c in WRITE_CLAUSES)
    return (F.trim(F.coalesce(query, F.lit(""))) != "") & ~F.coalesce(query, F.lit("")).rlike(rf"(?i)\b(?:{clauses})\b")


def public_url(url: Column) -> Column:
    """An http or https URL with a host which, if it is a literal address (IPv4, or IPv6 in brackets), lies in the public part of the address space; names are not looked up.

    A host of digits and dots that is no full IPv4 address, an IPv6 address with an embedded IPv4 one, and localhost are refused.
    """
    host = F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?(\[[^\]/?#]*\]|[^/:?#\[\]]+)", 1))
    literal, six = F.regexp_extract(host, r"^\[(.*)\]$", 1), host.startswith("[")
    four = host.rlike(r"^(?:0x[0-9a-f]*|[0-9.]+)$")
    good4 = host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & ~host.rlike(INNER_IPV4)
    good6 = literal.rlike(PUBLIC_IPV6) & ~literal.rlike(INNER_IPV6) & ~literal.contains(".")
    return F.coalesce(F.trim(url).rlike(r"(?i)^https?://") & (host != "") & (host != "localhost") & F.when(six, good6).when(four, good4).otherwise(True), F.lit(False))


def _of(text: Column, chars: str, least: int = 1, most: int = 1 << 30) -> Column:
    """Whether a text is `least` to `most` of the given characters and nothing else."""
    return F.char_length(text).between(least, most) & (F.translate(text, chars, "") == "")


def is_arxiv_id(token: Column) -> Column:
    """An identifier in arXiv's published scheme: yymm.number of four or five digits, or archive[.CL]/yymmnnn of seven; either may end in a version, v and digits."""
    bare = F.regexp_replace(token, r"v\d+$", "")
    new = let(F.split(bare, r"\."), lambda p: (F.size(p) == 2) & _of(F.get(p, F.lit(0)), DIGIT, 4, 4) & _of(F.get(p, F.lit(1)), DIGIT, 4, 5))
    archive = lambda a: _of(F.get(a, F.lit(0)), SMALL + "-") & ((F.size(a) == 1) | ((F.size(a) == 2) & _of(F.get(a, F.lit(1)), CAPITAL, 2, 2)))
    old = let(F.split(bare, "/"), lambda p: (F.size(p) == 2) & _of(F.get(p, F.lit(1)), DIGIT, 7, 7) & let(F.split(F.get(p, F.lit(0)), r"\."), archive))
    return F.coalesce(new | old, F.lit(False))


def arxiv_address(token: Column) -> Column:
    """What an address of an arXiv abstract or PDF names, null for other tokens."""
    part = lambda name: F.try_parse_url(token, F.lit(name))
    steps = F.split(F.regexp_replace(part("PATH"), r"(?i)\.pdf$", ""), "/", 3)
    ours = F.lower(part("PROTOCOL")).isin("http", "https") & F.lower(part("AUTHORITY")).isin("arxiv.org", "www.arxiv.org") & part("QUERY").isNull() & part("REF").isNull()
    return F.when(ours & F.lower(F.get(steps, F.lit(1))).isin("abs", "pdf"), F.nullif(F.get(steps, F.lit(2)), F.lit("")))


def is_category(token: Column) -> Column:
    """A category code: archive, full stop, subject class; each begins with a letter, an archive in small ones, and goes on in letters, digits and hyphens."""
    letters = SMALL + CAPITAL
    begins = lambda x, first, rest: _of(F.substring(x, 1, 1), first) & _of(x, rest + DIGIT + "-")
    return F.coalesce(let(F.split(token, r"\."), lambda p: (F.size(p) == 2) & begins(F.get(p, F.lit(0)), SMALL, SMALL) & begins(F.get(p, F.lit(1)), letters, letters)), F.lit(False))


def source_ids(spec: Column) -> Column:
    """The arXiv identifiers among a spec's tokens (cut at commas and white space), whole tokens or in addresses."""
    tokens = F.filter(F.split(F.coalesce(spec, F.lit("")), r"[,\s]+"), lambda t: t != "")
    found = F.transform(tokens, lambda t: F.coalesce(F.when(is_arxiv_id(t), t), arxiv_address(t)))
    return F.filter(found, lambda t: t.isNotNull())


def source_mode(spec: Column) -> Column:
    """id, category, keyword or default: what a free-text feed spec asks for."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    tokens = F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
    categories = (F.size(tokens) > 0) & F.forall(tokens, is_category)
    return F.when(F.size(source_ids(spec)) > 0, "id").when(categories, "category").when(F.trim(F.regexp_replace(s, r"\s+", " ")) != "", "keyword").otherwise("default")


def json_fields(text: Column, schema: str) -> Column:
    """A JSON object's fields; bad JSON and other values give the same struct with null fields, so that a caller finds an empty object."""
    read = F.from_json(text, schema)
    return F.coalesce(read, F.from_json(F.lit("{}"), schema))


def thread_title(question: Column) -> Column:
    return F.substring(F.trim(F.coalesce(F.nullif(question, F.lit("")), F.lit("Untitled"))), 1, 200)


def guarded_rewrite(question: Column, rewrite: Column) -> Column:
    """The trimmed rewrite unless it is blank or over 400 characters."""
    own = F.trim(F.coalesce(rewrite, F.lit("")))
    return F.when((own == "") | (F.char_length(own) > 400), question).otherwise(own)


def is_rewritten(question: Column, rewrite: Column) -> Column:
    """Whether the guarded rewrite differs from the question, ignoring case and outer white space."""
    return F.lower(F.trim(guarded_rewrite(question, rewrite))) != F.lower(F.trim(question))


def chunks(documents: DataFrame, size: int = 400, overlap: int = 40) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, text) of documents(workspace_id, doc_id, url, text)."""
    source = F.coalesce(F.nullif("url", F.lit("")), F.col("doc_id").cast("string"))
    got = documents.select("workspace_id", "doc_id", source.alias("source"), F.posexplode(chunk_words(F.coalesce("text", F.lit("")), size, overlap)).alias("chunk_index", "text"))
    return got.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.concat_ws(":", "workspace_id", "source", F.col("chunk_index").cast("string")).alias("chunk_id"), "text")
