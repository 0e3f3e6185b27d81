"""Chat formatting of typed content parts.

A visitor turns the parts of a message into one text: text as it is, and images, audio and documents
as placeholders in their order, with the attachment each one refers to and the number of tokens it
expands to. Each message is then framed by the template's marks; control strings inside texts are
escaped so that they can neither end a turn nor start one, and can be read back.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that one unit of an attachment expands to.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 28, 25, 256
PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
#: Backslash first, so that every escape is undone by dropping one backslash.
_CONTROL = "<|"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(_CONTROL), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a message of one text part; null counts as empty."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.array(F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null("string").alias("ref"), null("int").alias("width"),
        null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """What an attachment expands to: an image by its patches, audio by its seconds, a document by
    its pages; at least 1, also where the size is not known; 0 for text and unknown kinds."""
    up = lambda x: F.coalesce(F.ceil(x), F.lit(0)).cast("int")
    n = (F.when(part["kind"] == "image", up(part["width"] / PATCH) * up(part["height"] / PATCH))
         .when(part["kind"] == "audio", up(part["seconds"] * TOKENS_PER_SECOND))
         .when(part["kind"] == "document", up(part["pages"] * TOKENS_PER_PAGE)))
    return F.coalesce(F.greatest(n, F.lit(1)), F.lit(0))


def visit(parts: Column) -> tuple[Column, Column, Column]:
    """The flattened message, its attachments (kind, ref, slot and tokens, in order), and all its
    expanded tokens. A placeholder names its kind and its slot in the message. A part of an unknown
    kind, or a null one, is left out of the text and of the attachments."""
    parts = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p["kind"].isin("text", "image", "audio", "document"))
    media = F.transform(F.filter(parts, lambda p: p["kind"] != "text"), lambda p, i: F.struct(
        p["kind"].alias("kind"), p["ref"].alias("ref"), i.alias("slot"), part_tokens(p).alias("tokens")))
    slot = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda q: q["kind"] != "text"))
    # a bar at the start of a later part could complete a control string that the part before begins
    bar = lambda t, i: F.when((i > 0) & t.startswith("|"), F.concat(F.lit("\\"), t)).otherwise(t)
    shown = F.transform(parts, lambda p, i: F.when(p["kind"] == "text", bar(escape(F.coalesce(p["text"], F.lit(""))), i)).otherwise(
        F.concat(F.lit("<|"), p["kind"], F.lit(":"), slot(i).cast("string"), F.lit("|>"))))
    return F.array_join(shown, ""), media, F.aggregate(media, F.lit(0), lambda a, m: a + m["tokens"])


def format_turns(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv_id, turn, role, formatted, loss_start, loss_chars, attachments, expanded_tokens), a row
    for each message: the framed text, and the stretch of it that is trained on (code points, from
    0), which is an assistant's text without its frame; elsewhere loss_chars is 0.

    A null role counts as empty; line ends in a role are escaped. Null parts make an empty message.
    Repeated rows stay, as turns of their own. Other columns are left out."""
    shown, media, tokens = visit(F.col(parts))
    who = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(TURN), F.replace(escape(who), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    rows = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), head.alias("h"), shown.alias("b"), media.alias("attachments"), tokens.alias("expanded_tokens"))
    trained = F.col("role") == "assistant"
    return rows.select(
        "conv_id", "turn", "role", F.concat("h", "b", F.lit(END)).alias("formatted"), F.length("h").alias("loss_start"),
        F.when(trained, F.length("b")).otherwise(0).alias("loss_chars"), "attachments", "expanded_tokens")


def read_back(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments,
    expanded_tokens), a row for each conversation, from formatted turns: the framed text is taken
    apart again, unescaped, and digested in the order of turns (then role, then text).

    Turns of a conversation are sorted by Spark, which spills, and pass through as a stream of
    digests, so a conversation of any length needs little memory. A null conv_id is one conversation;
    null turns come first."""
    body = F.expr(f"substring(formatted, {len(TURN) + 1}, length(formatted) - {len(TURN) + len(END)})")
    cut = turns.withColumn("body", body).withColumn("at", F.instr("body", "\n"))
    role = F.expr("substring(body, 1, at - 1)")
    back = cut.select(
        "conv_id", "turn", unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")).alias("role"), unescape(F.expr("substring(body, at + 1)")).alias("text"),
        F.length("formatted").cast("long").alias("chars"), unescape(F.expr("substring(formatted, loss_start + 1, loss_chars)")).alias("loss"),
        F.size("attachments").cast("long").alias("attachments"), F.col("expanded_tokens").cast("long").alias("tokens"))
    part = back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = back.schema["conv_id"].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachments", "expanded_tokens"]
        types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        own, state, done = None, None, []

        def closed():
            n, turns, chars, loss, size, media, tokens = state
            return (own, n, turns.hexdigest(), chars, loss.hexdigest(), size, media, tokens)

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for conv, _, role, text, size, loss, media, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != own:
                    if state is not None:
                        done.append(closed())
                    own, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += size
                state[5] += media
                state[6] += tokens
            if done:
                yield flush()
                done = []
        if state is not None:
            done.append(closed())
            yield flush()

    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, attachments bigint, expanded_tokens bigint"
    return part.mapInArrow(run, schema)


def assembled(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): each conversation as one text, for those who want it so; the row is as
    long as the conversation."""
    got = F.sort_array(F.collect_list(F.struct("turn", "role", "formatted")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(got, lambda t: t["formatted"]), "").alias("formatted"))
