"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of anything but ASCII white space (tab to carriage return, and space).
WORD = r"[^\x20\x09-\x0D]+"
#: The two ASCII alphabets that lower-casing maps; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ids are broadcast up to this number (16 bytes each in memory); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables in a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where nothing names one, a temporary folder is set for this session if driver and executors are one process; on a
    cluster that would be a different folder on each machine, so it is an error.
    """
    context = spark.sparkContext
    there = context._jsc.sc().getCheckpointDir()
    if there.isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(configured or "file://" + tempfile.mkdtemp(prefix="sceneloom-"))
        there = context._jsc.sc().getCheckpointDir()
    return there.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name for one run's files in the shared folder."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex[:12]}"


def whole_number_ids(df: DataFrame, id_column: str) -> None:
    """Raises an error unless the ids are whole numbers."""
    if df.schema[id_column].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_column} has to be of whole numbers, not {df.schema[id_column].dataType.simpleString()}")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it if df has such a column (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_slices(texts: pa.Array, n_bytes: int) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of texts of about n_bytes together, or of one text that is longer. Memory that the last run has freed is given back."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.flatnonzero(np.diff(np.cumsum(sizes) // n_bytes, prepend=-1))
    for run in zip(starts.tolist(), np.diff(starts, append=len(texts)).tolist(), strict=True):
        yield run
        pa.default_memory_pool().release_unused()


def hashed_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, end to end, and each text's number of words. Each distinct word is hashed once.

    Words are runs of anything but ASCII white space; with lower, A to Z are in lower case first.
    """
    texts = texts.fill_null("")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    sizes = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    numbered = split.flatten().dictionary_encode()
    words, codes = numbered.dictionary.cast(pa.binary()).to_pylist(), numbered.indices.to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    if b"" in words:  # what stands before a first space or after a last one is no word
        real = codes != words.index(b"")
        sizes = np.bincount(np.repeat(np.arange(len(texts)), sizes)[real], minlength=len(texts))
        codes = codes[real]
    return hashes[codes], sizes


def if_few(df: DataFrame) -> DataFrame:
    """df, whose rows are a few numbers each, marked to be broadcast if it has MOST_BROADCAST rows at most. df is counted, so it should be kept."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def without(docs: DataFrame, gone: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs without the rows whose id and hash of the text are among gone's doc_id and tie. A null id is one like others."""
    own, tie = free_name(docs, "_gone_id"), free_name(docs, "_gone_tie")
    gone = if_few(checkpointed(gone.select(F.col("doc_id").alias(own), F.col("tie").alias(tie)).distinct()))
    return docs.join(gone, F.col(id_column).eqNullSafe(F.col(own)) & (F.xxhash64(text_column) == F.col(tie)), "left_anti")


def words_of(text: Column) -> Column:
    """All words of a text, in order; none for a null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words_of(text: Column) -> Column:
    """The number of words of a text, as a long; 0 for a null text.

    A word begins at each non-space that follows a space or the start, so with every word cut
    to one character the length is the count.
    """
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)
