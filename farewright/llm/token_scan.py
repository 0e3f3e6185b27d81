"""Token counts of documents in flat token files that have no index.

A flat file is token ids, one document after the other, each closed by an end-of-document id. It is
held as blocks of a fixed number of tokens that do not care where documents end. Each block is
searched on its own; a prefix scan over what the blocks found (tokens, separators, and the last
separator) then gives each separator its number in the file and each document its start, wherever
blocks cut it.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewright.llm.shared import shared_dir

BLOCK_TOKENS = 1 << 20
#: Blocks whose prefix is made by one task, before the prefix of such groups.
GROUP = 1024
#: Ids of documents in a row of the manifest.
MANIFEST = 4096
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256
#: Raw files are dealt to tasks by so many bytes.
TASK_BYTES = 128 << 20
#: Runs of white space (the property, as fixed values) of so many characters are cut off before the
#: tokenizer sees them: its look-ahead would need a stack as deep as the run is long.
LONG_SPACE = 1 << 14
_SPACE = "[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LONG = re.compile(f"(?<!{_SPACE}){_SPACE}{{{LONG_SPACE},}}")


@lru_cache(maxsize=2)
def _encoder(ranks: bytes):
    """The function from a text to its token ids."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    words = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    one = tiktoken.Encoding("piece", pat_str=r"(?s).+", mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        """As the pattern splits a run of white space: its last character goes with what follows, the
        others are one piece; all of it is, at the end of the text."""
        if len(text) < LONG_SPACE:
            return words(text)
        out, at = [], 0
        for run in _LONG.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += words(text[at : run.start()])
            out += one(text[run.start() : end])
            at = end
        return out + words(text[at:])

    return encode


def write_flat(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER,
               eod: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """Tokenises whole texts into one flat file for each partition, written to the shared folder.
    Returns its table: block rows (file, seq, payload) and manifest rows (file, seq, ids), the ids
    of the file's documents in order. A null or empty text is a document of no tokens.

    The vocabulary goes to every task; it has a row for each id, and ids have to fit dtype (65,536 of
    them for two bytes)."""
    import uuid

    with open(tokenizer, "rb") as f:
        ranks = f.read()
    if max(eod, ranks.count(b"\n")) > np.iinfo(dtype).max:
        raise ValueError(f"ids of the vocabulary do not fit {dtype}")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    source = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("file", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("payload", T.BinaryType()),
        T.StructField("ids", T.ArrayType(source.schema["id"].dataType))])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, file, encode = to_arrow_schema(schema), TaskContext.get().partitionId(), _encoder(sent.value)
        ids, parts, held, n_blocks, n_lists = [], [], 0, 0, 0

        def row(seq, payload, own):
            return pa.RecordBatch.from_arrays([pa.array([v], arrow.field(i).type) for i, v in enumerate((file, seq, payload, own))], schema=arrow)

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(own)
                tokens = np.array([*(encode(text) if text else ()), eod], dtype)
                parts.append(tokens)
                held += len(tokens)
                if held >= block_tokens:
                    flat = np.concatenate(parts)
                    for cut in range(0, held - block_tokens + 1, block_tokens):
                        yield row(n_blocks, flat[cut : cut + block_tokens].tobytes(), None)
                        n_blocks += 1
                    held %= block_tokens
                    parts = [flat[len(flat) - held :]]
                if len(ids) == MANIFEST:
                    yield row(n_lists, None, ids)
                    ids, n_lists = [], n_lists + 1
        if held:
            yield row(n_blocks, np.concatenate(parts).tobytes(), None)
        if ids:
            yield row(n_lists, None, ids)

    path = f"{shared_dir(docs.sparkSession)}/flat-{uuid.uuid4().hex}"
    source.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def blocks_of(flat: DataFrame) -> DataFrame:
    return flat.where("payload is not null").select("file", "seq", "payload")


def _opened(uri: str):
    """A file for random reads, by whatever store its address names."""
    if urlsplit(uri).scheme in ("", "file"):
        return pyarrow.fs.LocalFileSystem().open_input_file(unquote(urlsplit(uri).path))
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def read_flat_files(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Raw flat files of other makers, cut into blocks (file, seq, payload). Spark lists the files;
    tasks read ranges of them, so a file of any length spreads over tasks and none is held whole.
    Tasks need a store that pyarrow.fs can open (local, HDFS, S3, GCS)."""
    size = block_tokens * np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    cut = files.select("file", "length", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("seq"))
    total = files.agg(F.sum("length")).first()[0] or 0

    def run(batches):
        for batch in batches:
            for file, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(file) as f:
                    payload = f.read_at(min(size, f.size() - seq * size), seq * size)
                yield pa.RecordBatch.from_pydict({"file": [file], "seq": pa.array([seq], pa.int64()), "payload": pa.array([payload], pa.binary())})

    dealt = cut.select("file", "seq").repartition(max(1, -(-total // task_bytes)))
    return dealt.mapInArrow(run, "file string, seq bigint, payload binary")


def find_separators(blocks: DataFrame, eod: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """(file, seq, n, at): for each block its tokens and the places of its separators."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            found, sizes = [], []
            for payload in batch.column(2):
                raw = payload.as_buffer()
                if raw.size % width:
                    raise ValueError("a flat file ends within a token")
                tokens = np.frombuffer(raw, dtype)
                sizes.append(len(tokens))
                found.append(np.flatnonzero(tokens == eod).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), lists], names=["file", "seq", "n", "at"])

    kind = blocks.schema["file"].dataType.simpleString()
    return blocks.mapInArrow(run, f"file {kind}, seq bigint, n bigint, at array<int>")


def documents(found: DataFrame) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended): each document of each file, from a written table of
    find_separators. Tokens after a file's last separator are a document that has not ended.

    The scan has two levels, groups of blocks and blocks of a group, so that no task gets a file's
    blocks whole; its rows are a few numbers for each block."""
    group = (F.col("seq") / GROUP).cast("long").alias("g")
    each = found.select("file", "seq", group, "n", F.size("at").cast("long").alias("k"), F.try_element_at("at", F.lit(-1)).alias("last"))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = upto("file", "g", "seq")
    placed = each.withColumn("n0", F.coalesce(F.sum("n").over(inner), F.lit(0))).withColumn("k0", F.coalesce(F.sum("k").over(inner), F.lit(0)))
    placed = placed.withColumn("end", F.col("n0") + F.col("last")).withColumn("last0", F.max("end").over(inner))
    groups = placed.groupBy("file", "g").agg(F.sum("n").alias("gn"), F.sum("k").alias("gk"), F.max("end").alias("gend"))
    outer = upto("file", "g")
    groups = groups.withColumn("gn0", F.coalesce(F.sum("gn").over(outer), F.lit(0))).withColumn("gk0", F.coalesce(F.sum("gk").over(outer), F.lit(0)))
    groups = groups.withColumn("gabs", F.col("gn0") + F.col("gend")).withColumn("glast0", F.coalesce(F.max("gabs").over(outer), F.lit(-1)))
    base = placed.join(groups, ["file", "g"]).select(
        "file", "seq", (F.col("gn0") + F.col("n0")).alias("base"), (F.col("gk0") + F.col("k0")).alias("first"),
        F.coalesce(F.col("gn0") + F.col("last0"), "glast0").alias("before"))
    ends = found.join(base, ["file", "seq"]).select("file", "base", "first", "before", "at", F.posexplode("at").alias("j", "p"))
    previous = F.when(F.col("j") == 0, F.col("before")).otherwise(F.expr("base + at[greatest(j - 1, 0)]"))
    whole = ends.withColumn("previous", previous)
    whole = whole.select("file", (F.col("first") + F.col("j")).alias("ordinal"), (F.col("previous") + 1).alias("start"),
                         (F.col("base") + F.col("p") - F.col("previous") - 1).alias("n_tokens"), F.lit(True).alias("ended"))
    files = groups.groupBy("file").agg(F.sum("gn").alias("n"), F.sum("gk").alias("k"), F.coalesce(F.max("gabs"), F.lit(-1)).alias("last"))
    rest = files.where("last + 1 < n").select("file", F.col("k").alias("ordinal"), (F.col("last") + 1).alias("start"), (F.col("n") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def named(counted: DataFrame, flat: DataFrame) -> DataFrame:
    """(doc_id, file, ordinal, start, n_tokens): the documents with their ids from the manifest."""
    listed = flat.where("ids is not null").select("file", "seq", F.posexplode("ids").alias("j", "doc_id"))
    listed = listed.select("file", (F.col("seq") * MANIFEST + F.col("j")).alias("ordinal"), "doc_id")
    return listed.join(counted, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
