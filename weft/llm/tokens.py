"""Token counts by a separator scan of flat, unindexed token streams.

A stream is a sequence of token ids in which one id ends each document; nothing
says where. It is stored as blocks of equal size that cut documents anywhere. A
block is searched for separators at once; it says how many it has and where the
last one is. A prefix scan over these summaries, one row a block, gives each
block the number of documents before it and the place of the last separator
before it; its separators' distances then are the documents' token counts.

The scan has two levels, groups of GROUP blocks and blocks in a group, so that a
stream of any length is scanned in small windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.llm.common import cut

BLOCK = 1 << 16
GROUP = 1024
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SEPARATOR = 50256
#: A text is encoded in parts of about so many characters, cut before white space.
PART = 1 << 15


def _encoder(path: str):  # noqa: ANN202
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_parts(encode, text: str, part: int = PART) -> list[int]:  # noqa: ANN001
    """Ids of a text; a long one is cut before single spaces between letters, where the pattern cuts too."""
    out, at = [], 0
    while len(text) - at > part:
        stop = text.find(" ", at + part)
        while stop > 0 and not (text[stop - 1].isalpha() and text[stop + 1 : stop + 2].isalpha()):
            stop = text.find(" ", stop + 1)
        if stop < 0:
            break
        out += encode(text[at:stop])
        at = stop
    return out + encode(text[at:])


def write_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Blocks (stream, block, tokens uint16 binary, ids): one stream per partition of docs.

    ids lists the documents that end in the block, in order: what the stream itself
    doesn't say. Every document ends with the separator; null counts as empty. The
    blocks are written to the shared folder, since a stream's number is the place of
    its task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        stream, k, held, ids = TaskContext.get().partitionId(), 0, 0, []
        parts: list[np.ndarray] = []
        ends: list[int] = []

        def emit(n: int) -> pa.RecordBatch:
            nonlocal held, parts, ids, ends, k
            whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
            inside = int(np.searchsorted(ends, n))
            row = pa.RecordBatch.from_arrays([pa.array([stream], pa.int32()), pa.array([k], pa.int64()), pa.array([whole[:n].tobytes()], pa.binary()), pa.array([ids[:inside]], pa.list_(kind))], ["stream", "block", "tokens", "ids"])
            parts, held, ids, ends, k = [whole[n:]], held - n, ids[inside:], [e - n for e in ends[inside:]], k + 1
            return row

        for b in batches:
            kind = b.column(0).type
            for i, text in zip(b.column(0), b.column(1), strict=True):
                parts.append(np.array([*encode_parts(encode, text.as_py() or ""), SEPARATOR], np.uint16))
                held += len(parts[-1])
                ids.append(i.as_py())
                ends.append(held - 1)
                while held >= block:
                    yield emit(block)
        if held:
            yield emit(held)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(run, f"stream int, block long, tokens binary, ids array<{kind}>"))


def count_tokens(blocks: DataFrame, *, separator: int = SEPARATOR, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(stream, ordinal, block, place, n_tokens) of every document of blocks(stream, block, tokens).

    Documents of a stream are numbered from 0 in order; block and place say where
    the document ends: its place among the block's ends. All blocks but a stream's
    last have `block` tokens. Tokens after the last separator are a document
    without an end (place null) if there are any. Separators next to each other give
    documents of 0 tokens. No blocks give no rows.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for t in b.column(2):
                x = np.frombuffer(t.as_py() or b"", np.uint16)
                at.append(np.flatnonzero(x == separator).astype(np.int32))
                n.append(len(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32()))], ["stream", "block", "n", "ends"])

    found = cut(blocks.select("stream", "block", "tokens").mapInArrow(find, "stream int, block long, n long, ends array<int>"))
    start = F.col("block") * block
    summary = found.select("stream", "block", F.floor(F.col("block") / group).alias("g"), F.size("ends").cast("long").alias("k"), (start + F.try_element_at("ends", F.lit(-1))).alias("last"), (start + F.col("n")).alias("stop"))
    groups = summary.groupBy("stream", "g").agg(F.sum("k").alias("k"), F.max("last").alias("last"))
    over = W.partitionBy("stream").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("stream", "g", F.sum("k").over(over).alias("k0"), F.max("last").over(over).alias("last0"))
    over = W.partitionBy("stream", "g").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scan = (
        summary.withColumn("k1", F.sum("k").over(over)).withColumn("last1", F.max("last").over(over)).join(groups, ["stream", "g"])
        .select("stream", "block", (F.coalesce("k0", F.lit(0)) + F.coalesce("k1", F.lit(0))).alias("first"), F.greatest(F.coalesce("last1", "last0"), F.coalesce("last0", F.lit(-1))).alias("before"))
    )
    ends = found.join(scan, ["stream", "block"]).select("stream", "block", "first", "before", F.transform("ends", lambda e: e + start).alias("ends"))
    whole = ends.select("stream", "block", "first", "before", "ends", F.posexplode("ends").alias("place", "end")).select(
        "stream",
        (F.col("first") + F.col("place")).alias("ordinal"),
        "block",
        "place",
        (F.col("end") - F.when(F.col("place") > 0, F.get("ends", F.col("place") - 1)).otherwise(F.col("before")) - 1).cast("long").alias("n_tokens"),
    )
    # A stream's end, from one row a group.
    tail = summary.groupBy("stream").agg(F.sum("k").alias("ordinal"), F.max("block").alias("block"), (F.max("stop") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens"))
    open_ = tail.where("n_tokens > 0").select("stream", "ordinal", "block", F.lit(None).cast("int").alias("place"), "n_tokens")
    return whole.unionByName(open_)


def document_token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row per input row: id, n_tokens, by writing a stream and scanning it."""
    blocks = write_stream(docs, id_col, text_col, **options)
    counts = count_tokens(blocks, block=options.get("block", BLOCK))
    names = blocks.select("stream", "block", F.posexplode("ids").alias("place", id_col))
    return counts.join(names, ["stream", "block", "place"]).select(id_col, "n_tokens", "stream", "ordinal")
