"""Operator 9: token counts by a separator scan of flat, unindexed token files.

A token file is nothing but ids, documents ended by the end-of-document id. Files are read by ranges of
bytes; each range is searched for that id with array operations, and a prefix scan over the ranges' counts
and offsets numbers the documents and joins the pieces of those that cross from one range to the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wakelag.llm.bpe import Codec
from wakelag.llm.common import cut, scratch, text_slices

#: Ids of a range.
BLOCK = 1 << 17
#: The end-of-document id: free in the rank files of 50,256 ids.
EOD = 50256
KIND = "<u2"
#: Documents whose keys stand in one row of a list of contents.
NAMES = 4096


def _open(path: str):
    """(file system, path there) of an address, for reading and writing where the task runs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def checked(ids: np.ndarray, eod: int, kind: np.dtype) -> np.ndarray:
    """ids in the files' type; one that does not fit it, or is the separator, is refused."""
    if len(ids) and (int(ids.max()) > np.iinfo(kind).max or int(ids.min()) < 0 or bool((ids == eod).any())):
        raise ValueError(f"an id does not fit {kind} or is the separator {eod}")
    return ids.astype(kind)


def write_files(df: DataFrame, codec: Codec, folder: str, key: str = "doc_id", text: str = "text", eod: int = EOD, kind: str = KIND) -> DataFrame:
    """Writes df as flat token files in `folder`, one a task; returns their contents, which are written too.

    Contents: (path, length, first, keys), each row the keys of some documents of a file in order, from
    document number `first` on: which documents stand in the file, but neither where nor how long they are.
    Null texts are empty documents: a separator only. A task that is tried again writes a file of another
    name, and only the file of the try that succeeded is listed. The folder must be one that executors share.
    """
    kind_ = np.dtype(kind)
    if eod > np.iinfo(kind_).max:
        raise ValueError(f"the separator {eod} does not fit {kind}")
    typed = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, key_type, end = f"{folder}/{uuid.uuid4().hex}.bin", pa.int64(), np.array([eod], dtype=kind_)
        keys, length, out = [], 0, None
        try:
            for batch in batches:
                key_type = batch.schema.field(0).type
                for piece in text_slices(batch, "text"):
                    if out is None:
                        system, inner = _open(at)
                        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                        out = system.open_output_stream(inner)
                    held = [x for t in piece.column(1).to_pylist() for x in (checked(codec.encode(t), eod, kind_), end)]
                    raw = np.concatenate(held).tobytes() if held else b""
                    out.write(raw)
                    length += len(raw)
                    keys.append(piece.column(0))
        finally:
            if out is not None:
                out.close()
        if keys:
            every = pa.chunked_array(keys).combine_chunks()
            firsts = range(0, len(every), NAMES)
            offsets = pa.array([*firsts, len(every)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([at] * len(firsts)), pa.array([length] * len(firsts), pa.int64()), pa.array(list(firsts), pa.int64()), pa.ListArray.from_arrays(offsets, every.cast(key_type))], ["path", "length", "first", "keys"])

    return cut(df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"path string, length long, first long, keys array<{typed}>"))


def find_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the flat token files at a path, folder or glob; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def ranges(files: DataFrame, kind: str = KIND, block: int = BLOCK) -> DataFrame:
    """(path, seq, offset, size) for files (path, length): ranges of `block` ids, dealt out one by one, so a
    file of any size is many tasks' work. A file that does not end with a whole id is refused."""
    width = np.dtype(kind).itemsize
    odd = F.when(F.col("length") % width != 0, F.raise_error(F.concat(F.lit("not a whole number of ids: "), "path"))).otherwise(F.col("length"))
    step = F.lit(block * width).cast("long")
    d = files.select("path", odd.alias("length")).where("length > 0").withColumn("seq", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("length") - 1, step))))
    d = d.withColumn("offset", F.col("seq") * step).withColumn("size", F.least(step, F.col("length") - F.col("offset")))
    return d.select("path", "seq", "offset", "size").repartition("path", "seq")


def summaries(ranges: DataFrame, eod: int = EOD, kind: str = KIND) -> DataFrame:
    """For each range of a file: its ids, separators, offsets of the first and last separator (null: none),
    and the lengths of the documents that lie between two of its separators."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, stream = None, None
        for batch in batches:
            for path, seq, offset, size in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if path != where:
                    if stream is not None:
                        stream.close()
                    system, inner = _open(path)
                    where, stream = path, system.open_input_file(inner)
                ids = np.frombuffer(stream.read_at(size, offset), dtype=kind)
                at = np.flatnonzero(ids == eod)
                cols = [[path], [seq], [len(ids)], [len(at)], [int(at[0]) if len(at) else None], [int(at[-1]) if len(at) else None]]
                types = [pa.string(), *[pa.int64()] * 5]
                inner_ = pa.array([np.diff(at) - 1], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=True)], inner_], ["path", "seq", "n", "seps", "head", "tail", "inner"])
        if stream is not None:
            stream.close()

    return ranges.sortWithinPartitions("path", "seq").mapInArrow(run, "path string, seq long, n long, seps long, head long, tail long, inner array<long>")


def count(files: DataFrame, eod: int = EOD, kind: str = KIND, block: int = BLOCK) -> DataFrame:
    """One row for each document of files (path, length): path, ordinal (from 0), n_tokens, ended.

    `ended` is false for ids after a file's last separator. Two separators in a row hold an empty document.
    Files without ids, and no files, give no rows. The prefix scan runs over a few numbers a range; the lengths
    found inside ranges do not pass through it.
    """
    before = W.partitionBy("path").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    up_to = W.partitionBy("path").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = cut(summaries(ranges(files, kind, block), eod, kind))
    s = found.drop("inner")
    s = s.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    s = s.withColumn("done", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    s = s.withColumn("open", F.coalesce(F.max(F.col("at") + F.col("tail") + 1).over(before), F.lit(0)))
    s = s.withColumn("shut", F.coalesce(F.max(F.col("at") + F.col("tail") + 1).over(up_to), F.lit(0)))
    s = cut(s.withColumn("final", F.lead("seq").over(W.partitionBy("path").orderBy("seq")).isNull()))
    total = F.col("at") + F.col("n")
    # the document that a range's first separator ends, those inside, and what a file's end leaves open
    first = s.where("seps > 0").select("path", F.col("done").alias("ordinal"), (F.col("at") + F.col("head") - F.col("open")).alias("n_tokens"), F.lit(True).alias("ended"))
    inside = found.where("size(inner) > 0").select("path", "seq", "inner").join(s.select("path", "seq", "done"), ["path", "seq"]).select("path", "done", F.posexplode("inner").alias("i", "n_tokens"))
    inside = inside.select("path", (F.col("done") + F.col("i") + 1).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    rest = s.where(F.col("final") & (total > F.col("shut"))).select("path", (F.col("done") + F.col("seps")).alias("ordinal"), (total - F.col("shut")).alias("n_tokens"), F.lit(False).alias("ended"))
    return first.unionByName(inside).unionByName(rest)


def token_counts(df: DataFrame, codec: Codec, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Tokens of each document, counted in the flat files that the documents are encoded to.

    One row for each row of df: key, n_tokens, path and ordinal (which file, which document in it). Null
    texts have no tokens; an empty table gives no rows. Keys may repeat or be null: documents are told apart by
    place. Other columns of df are not read.
    """
    contents = write_files(df, codec, scratch(df.sparkSession, "tokens"), key, text)
    counts = count(contents.select("path", "length").where("first = 0"), block=block)
    names = contents.select("path", "first", F.posexplode("keys").alias("i", "key")).select("path", (F.col("first") + F.col("i")).alias("ordinal"), "key")
    return names.join(counts, ["path", "ordinal"]).select(F.col("key").alias(key), "n_tokens", "path", "ordinal")
