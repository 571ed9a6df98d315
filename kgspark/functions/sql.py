"""Table functions for SQL users: `chunk_words` and `char_windows` as temporary SQL functions, planned by Catalyst like any other query."""

from __future__ import annotations

from pyspark.sql import SparkSession

CHUNK_WORDS = r"""
create or replace temporary function chunk_words(body string, size int, overlap int) returns table (chunk_index int, chunk string)
return select i, case when n <= size then body else array_join(slice(w, i * (size - overlap) + 1, size), ' ') end
from (select w, size(w) as n, explode(sequence(0, greatest(0, cast(ceil((size(w) - chunk_words.size) / (chunk_words.size - overlap)) as int)))) as i
      from (select filter(split(body, '(?U)\\s+'), x -> x <> '') as w))"""
CHAR_WINDOWS = """
create or replace temporary function char_windows(body string, width int, overlap int) returns table (window int, part string)
return select i, case when length(body) <= width then body else substring(body, i * (width - overlap) + 1, width) end
from (select explode(sequence(0, case when length(body) <= width then 0 else cast(ceil(length(body) / (width - overlap)) as int) - 1 end)) as i)"""


def register(spark: SparkSession) -> None:
    """`select d.doc_id, c.* from documents d, lateral chunk_words(d.text, 400, 40) c` works in this session from now on."""
    for text in (CHUNK_WORDS, CHAR_WINDOWS):
        spark.sql(text)
