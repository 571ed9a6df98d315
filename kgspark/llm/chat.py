"""Chat formatting by event sourcing: fold conversation logs into final messages, then render turns.

Events (conv_id, seq, kind, msg_id, role, text), seq of any type that Spark orders, in order of (seq, kind, role, text) within a message:
- `message` starts a message (role, text), or starts it afresh;
- `delta` appends text;
- `edit` replaces the text so far;
- `regenerate` clears the message's text, and drops every message of the conversation that began after
  it and before this event; later deltas fill it again.
A message stands where its first event stood. Events of no known kind, and messages with no `message`
event, are kept with role null (rendered empty) so that no text is lost.

Folding groups by message, not by conversation, and rendering works row by row: a conversation of any length
is never held whole. `digests` walks the rendered turns of a conversation in order with constant state: a digest of a sequence can't be computed in
parts, so each conversation's turns pass through one task, sorted by Spark (on disk where needed) and one at a time.

The template is `### {role}: {text}</turn>\\n`. In roles and texts `\\` becomes `\\0`, `###` `\\3`, `</turn>`
`\\t`, and in roles `:` `\\c`, so no text can forge a turn and parsing gives every text back.

Defined cases: null role or text: empty; repeated rows: a turn each; a conversation of one turn, empty and
very long texts: as they are; an empty table gives no rows; extra columns are ignored; null conv_id: one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm.common import partitions, written

EVENTS = "conv_id long, seq struct<known: boolean, turn: long, n: long, at: long>, kind string, msg_id string, role string, text string"
DELTA = 2_000


def events_of(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a chat service whose final messages they are.

    A turn is begun, then streamed in deltas of `delta` code points. By a hash, a quarter of the turns are begun with a draft that an edit
    replaces, a quarter stream a draft that is regenerated, and a quarter also had a reply to the draft, which the regeneration drops.
    """
    one = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.row_number().over(one).cast("long"))
    n, variant = F.char_length("text"), F.pmod(F.xxhash64("conv_id", "turn", "n"), F.lit(4))
    draft = F.substring("text", F.lit(1), F.least(F.floor(n / 2), F.lit(delta)).cast("int"))
    event = lambda at, kind, own, text: F.struct(F.lit(at).cast("long").alias("at"), kind.alias("kind"), F.lit(own).alias("own"), text.alias("text"))
    start = event(0, F.lit("message"), True, F.when(variant == 1, draft).otherwise(""))
    reply = [event(2, F.lit("message"), False, F.lit("")), event(3, F.lit("delta"), False, draft)]
    again = event(4, F.lit("regenerate"), True, F.lit(None).cast("string"))
    first = event(1, F.lit("delta"), True, draft)
    before = F.when(variant == 3, F.array(start, first, *reply, again)).when(variant == 2, F.array(start, first, again)).otherwise(F.array(start))
    places = F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / delta), F.lit(0)).cast("int"))
    parts = F.transform(places, lambda i: event(i.cast("long") + 5, F.when((i == 0) & (variant == 1), "edit").otherwise("delta"), True, F.substring("text", i * delta + 1, F.lit(delta))))
    msg = F.concat_ws("/", F.coalesce(F.col("turn").cast("string"), F.lit("null")), "n")
    rows = rows.select("conv_id", "turn", "n", msg.alias("msg_id"), "role", F.explode(F.concat(before, parts)).alias("e"))
    # A turn's events follow one another; null turns come before all others.
    seq = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "n", F.col("e.at").alias("at"))
    msg_id, role = F.when(F.col("e.own"), F.col("msg_id")).otherwise(F.concat("msg_id", F.lit("/reply"))), F.when(F.col("e.own"), F.col("role")).otherwise("user")
    return rows.select("conv_id", seq.alias("seq"), F.col("e.kind").alias("kind"), msg_id.alias("msg_id"), role.alias("role"), F.col("e.text").alias("text"))


def folded(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, at, msg_id, role, text), `at` ordering them within a conversation."""
    e = events.select("conv_id", "seq", "kind", F.coalesce("msg_id", F.concat(F.lit("seq "), F.col("seq").cast("string"))).alias("msg_id"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    rows = e.groupBy("conv_id", "msg_id").agg(F.min("seq").alias("at"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"), log.alias("_log"))
    resets = F.transform("_log", lambda x, i: F.when(x["kind"].isin("message", "edit", "regenerate"), i))
    rows = rows.withColumn("_from", F.coalesce(F.array_max(resets), F.lit(0)))
    last = F.slice("_log", F.col("_from") + 1, F.size("_log"))
    text = F.array_join(F.transform(F.filter(last, lambda x: x["kind"] != "regenerate"), lambda x: x["text"]), "")
    role = F.element_at(F.filter("_log", lambda x: x["kind"] == "message"), -1)["role"]
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.exists("_log", lambda x: x["kind"] == "message"), role))
    again = e.where("kind = 'regenerate'").select("conv_id", "msg_id").distinct()
    light = e.groupBy("conv_id", "msg_id").agg(F.min("seq").alias("at"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("_again"))
    near = light.join(again.select(F.col("conv_id").alias("_c")).distinct(), F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    before = W.partitionBy("conv_id").orderBy("at", "msg_id").rowsBetween(W.unboundedPreceding, -1)
    gone = near.withColumn("_cut", F.max("_again").over(before)).where("_cut > at").select(F.col("conv_id").alias("_c"), F.col("msg_id").alias("_m"))
    rows = rows.join(gone, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("msg_id") == F.col("_m")), "left_anti")
    return rows.select("conv_id", "at", "msg_id", "role", "text")


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\0"), ("###", "\\3"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: str) -> str:
    return text.replace("\\t", "</turn>").replace("\\3", "###").replace("\\c", ":").replace("\\0", "\\")


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, at, msg_id, formatted, loss_start, loss_chars): each turn's output text and the part of it under the loss mask."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit("### "), F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit(": "))
    return messages.select(
        "conv_id", "at", "msg_id", F.concat(head, text, F.lit("</turn>\n")).alias("formatted"),
        F.when(role == "assistant", F.char_length(head)).cast("long").alias("loss_start"),
        F.when(role == "assistant", F.char_length(text)).cast("long").alias("loss_chars"),
    )


def parsed(formatted: str) -> tuple[str, str]:
    """(role, text) of one rendered turn."""
    m = re.fullmatch(r"### ([^:]*): (.*)</turn>\n", formatted, re.S)
    return unescaped(m[1]), unescaped(m[2])


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(output: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the rendered turns in their order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [f.split(" ")[0] for f in DIGEST.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def closed() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for batch in batches:
            for conv, formatted, start, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_chars")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(formatted)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[5] += len(formatted)
                if start is not None:
                    under = unescaped(formatted[start : start + chars])
                    state[3] += len(under)
                    state[4].update(under.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(closed(), types, strict=True)], names)

    rows = output.repartition(partitions(output.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at", "msg_id")
    return rows.select("conv_id", "formatted", "loss_start", "loss_chars").mapInArrow(run, DIGEST)


def formatted(events: DataFrame) -> DataFrame:
    """The rendered turns of a log of events, written to the shared folder."""
    return written(rendered(folded(events)), "chat")
