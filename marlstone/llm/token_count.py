"""Token counts by a separator scan of flat token files.

``write_tokens`` writes each partition's texts as one flat file of unsigned 16- or 32-bit identifiers, an end-of-document
identifier after each text and nothing else. ``scan`` counts tokens per document of such files, its own or others':
blocks of a file are read by themselves, separators are found with one vectorised comparison, and what a document holds
on either side of a block's edges is stitched by a prefix scan over the blocks' summaries (separators, tokens before the
first, tokens after the last). The scan goes over groups of blocks first, so the window over one file sees one row for
each ``GROUP`` blocks.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from marlstone.llm.common import fresh_path, open_fs, spread, written

TOKENIZERS, VOCABULARY, SEPARATOR = "/opt/tokenizers", "byte_bpe_50k.tiktoken", 50256
#: How byte-level BPE of this vocabulary cuts a text before merging; fixed value, as published with it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_BYTES, GROUP = 4 << 20, 1024


#: Characters the pattern takes for blanks; fixed value, the property White_Space of Unicode.
BLANKS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs of this many blanks are merged by themselves; other stretches are cut to about this many characters.
LONG_RUN, STRETCH = 10_000, 1 << 18
_RUN, _EDGE = re.compile(f"[{BLANKS}]{{{LONG_RUN},}}"), re.compile(f"(?<=[^{BLANKS}])(?=[{BLANKS}])")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible ones themselves, the others from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a ranks file, or of the same vocabulary as JSON; read once for each worker."""
    import tiktoken

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in word): n for word, n in model["model"]["vocab"].items() if word not in special}
    else:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str):
    """(stretch, whether it is one word of the pattern), in order: ``text`` cut where the pattern cuts it for certain.

    That is before a blank that follows none, and before the last blank of a run that more follows. So each stretch can
    be encoded by itself, and long runs of blanks, which the pattern's search can't take, need no search.
    """
    at = 0
    for run in [*_RUN.finditer(text), None]:
        stop = run.start() if run else len(text)
        while stop - at > STRETCH and (edge := _EDGE.search(text, at + STRETCH, stop)):
            yield text[at : edge.start()], False
            at = edge.start()
        if stop > at:
            yield text[at:stop], False
        if run:
            at = run.end() - (run.end() < len(text))
            yield text[stop:at], True


def tokens(text: str | None, path: str) -> np.ndarray:
    """Identifiers of the whole text; none for null. No text, whatever it says or how long, gives the separator or fails."""
    if not text:
        return np.empty(0, np.uint32)
    own, parts = encoder(path), []
    for part, is_word in stretches(text.encode("utf-8", "replace").decode("utf-8")):
        parts.append(np.array(own._encode_single_piece(part), np.uint32) if is_word else own.encode_to_numpy(part, disallowed_special=()))
    return np.concatenate(parts)


def write_tokens(docs: DataFrame, folder: str, path: str, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """(file, nth, doc_id), a row for each document of ``docs`` (doc_id, text), and the flat files under ``folder``.

    A file is named after its partition and attempt; only a task that succeeded has its rows in the result, so what
    lost attempts left behind is never read. ``path``, the ranks file, is the driver's: Spark sends it to the workers.
    """
    docs.sparkSession.sparkContext.addFile(path)
    ranks = os.path.basename(path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name = f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        nth, end = 0, np.array([separator], f"<u{width}").tobytes()
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for b in batches:
                for text in b.column(1):
                    out.write(tokens(text.as_py(), SparkFiles.get(ranks)).astype(f"<u{width}").tobytes() + end)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b)), pa.array(range(nth, nth + len(b)), pa.int64()), b.column(0)], ["file", "nth", "doc_id"])
                nth += len(b)

    return docs.select("doc_id", "text").mapInArrow(write, f"file string, nth long, doc_id {kind}")


def flat_blocks(spark: SparkSession, folder: str, names: DataFrame, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, start, length): byte ranges of whole identifiers of the files ``names`` (file)."""
    step = block_bytes // width * width

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        for b in batches:
            yield pd.DataFrame({"file": b["file"], "size": [fs.get_file_info(f"{base}/{x}").size for x in b["file"]]})

    of = names.select("file").mapInPandas(sizes, "file string, size long").where(f"size >= {width}")
    return of.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {step}"))).alias("block")).selectExpr(
        "file", "block", f"block * {step} AS start", f"least({step}, size div {width} * {width} - block * {step}) AS length"
    )


def scan(spark: SparkSession, folder: str, names: DataFrame, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, nth, n_tokens) for each document of the flat files ``names`` (file) under ``folder``.

    Documents end at a separator; tokens after a file's last one are a last document. Empty documents count 0, empty
    files have none.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(folder)
        for b in batches:
            for file, block, start, length in b[["file", "block", "start", "length"]].itertuples(index=False):
                with fs.open_input_file(f"{base}/{file}") as f:
                    ids = np.frombuffer(f.read_at(int(length), int(start)), dtype=f"<u{width}")
                at = np.flatnonzero(ids == separator)
                inner = np.diff(at) - 1
                head, tail = (int(at[0]), len(ids) - int(at[-1]) - 1) if len(at) else (len(ids), len(ids))
                yield pd.DataFrame({"file": [file], "block": [block], "n_sep": [len(at)], "head": [head], "tail": [tail], "inner": [inner.astype(np.int64)]})

    blocks = flat_blocks(spark, folder, names, width, block_bytes)
    blocks = spread(blocks, "file", "block")
    found = written(blocks.mapInPandas(search, "file string, block long, n_sep long, head long, tail long, inner array<bigint>"), "blocks")

    # An open document's tokens before a block are the tails since the last block with a separator. As a scan: with the
    # blocks' running token and separator counts, that is the running tokens less those at that separator.
    s = found.select("file", "block", "n_sep", "head", "tail", F.expr(f"block div {GROUP}").alias("grp"))
    within = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # carry: tokens left open before the block by the group's own blocks; fresh: whether one of them has a separator
    s = (
        s.withColumn("seps", F.coalesce(F.sum("n_sep").over(within), F.lit(0)))
        .withColumn("full", F.coalesce(F.sum(F.when(F.col("n_sep") == 0, F.col("tail")).otherwise(0)).over(within), F.lit(0)))
        .withColumn("mark", F.max(F.when(F.col("n_sep") > 0, F.struct("block", F.col("full").alias("at"), "tail"))).over(within))
    )
    groups = s.groupBy("file", "grp").agg(
        F.sum("n_sep").alias("g_sep"), F.sum(F.when(F.col("n_sep") == 0, F.col("tail")).otherwise(0)).alias("g_full"),
        F.max(F.when(F.col("n_sep") > 0, F.struct("block", F.col("full").alias("at"), "tail"))).alias("g_mark"), F.max("block").alias("g_end"),
    )
    across = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("g_sum", F.sum("g_full").over(upto)).withColumn("g_left", F.when(F.col("g_mark").isNotNull(), F.struct("grp", (F.col("g_sum") - F.col("g_full") + F.col("g_mark.at") - F.col("g_mark.tail")).alias("base"))))
    groups = groups.select(
        "file", "grp", F.coalesce(F.sum("g_sep").over(across), F.lit(0)).alias("seps_before"),
        (F.col("g_sum") - F.col("g_full") - F.coalesce(F.max("g_left").over(across)["base"], F.lit(0))).alias("open_before"),
        F.max("grp").over(Window.partitionBy("file")).alias("last_grp"), "g_end",
    )
    s = s.join(groups, ["file", "grp"])
    carry = F.when(F.col("mark").isNotNull(), F.col("full") - F.col("mark.at") + F.col("mark.tail")).otherwise(F.col("full") + F.col("open_before"))
    s = s.select("file", "block", (F.col("seps_before") + F.col("seps")).alias("first"), carry.alias("carry"), ((F.col("grp") == F.col("last_grp")) & (F.col("block") == F.col("g_end"))).alias("final"))
    d = found.join(s, ["file", "block"])
    opened = F.when(F.col("n_sep") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail"))
    here = F.when(F.col("n_sep") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<bigint>"))
    last = F.when(F.col("final") & (opened > 0), F.array(opened)).otherwise(F.array().cast("array<bigint>"))
    return d.select("file", "first", F.posexplode(F.concat(here, last)).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("nth"), "n_tokens")


def count_tokens(docs: DataFrame, path: str, separator: int = SEPARATOR, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens), a row per row of ``docs`` (doc_id, text): written as flat files in the shared folder, scanned back.

    Null and empty texts count 0; null and repeated doc_ids each keep their row; other columns are not used. A text of any
    length is one document of its file, whose blocks are read by themselves; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    order = written(write_tokens(docs, folder, path, separator, width), "order")
    counts = scan(spark, folder, order.select("file").distinct(), separator, width, block_bytes)
    return order.join(counts, ["file", "nth"]).select("doc_id", "n_tokens")


def op10_token_counts(spark, sf_dir: str, path: str = os.path.join(TOKENIZERS, VOCABULARY)) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
