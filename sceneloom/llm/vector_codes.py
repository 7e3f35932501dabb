"""Compression of vectors to codes: product quantisation whose codebooks Lloyd's algorithm fits exactly, with heaps.

Vectors are cut into equal parts; each position of a part has a codebook of its own. Heap Lloyd saves comparisons: a part
that has been compared with all entries knows how much nearer its entry is than the second (the slack, lower
minus upper bound). When entries move, the slack of all parts of an entry shrinks by the same drift at most: by what the entry itself
has moved and what the farthest moved of the others has. So the parts of an entry wait in a heap, keyed by their slack
plus the entry's cumulative drift when they were last compared; only those whose key the cumulative drift has passed are popped
and compared with all entries again. All others keep their entry, which is proven to be still the nearest.

Components are whole numbers, so distances, sums and codebooks are exact; bounds are floating-point numbers with a margin, and a
part within the margin is compared again. A task works on its own rows in batches, each with its own heaps; what passes from round to round
(codes and keys) is a table in the shared folder. The driver sees the codebooks and their sums, whose size does not depend on
the number of vectors.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import files
from .common import checkpointed, if_few, work_dir

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are multiplied by this and rounded down.
SCALE = 256
#: No component may be larger, once scaled, so that all sums of squares are exact in 64 bits.
LARGEST = 1 << 26
#: Vectors that are worked on at a time, and components of differences that are held at a time.
BATCH, HELD = 4096, 1 << 22
#: What bounds have to differ by, absolutely and in proportion.
MARGIN, RELATIVE = 1e-3, 1e-6


@dataclass
class Codebooks:
    """entries has, by part, entry and position, whole numbers; drift is each entry's cumulative drift, in the same order."""

    entries: np.ndarray
    drift: np.ndarray

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """The codebooks after one round: each used entry is the mean of its parts, rounded down."""
        used = counts > 0
        means = np.floor_divide(sums, np.maximum(counts, 1)[:, :, None])
        entries = np.where(used[:, :, None], means, self.entries)
        way = np.sqrt(((entries - self.entries) ** 2).sum(axis=2).astype(float))
        others = np.broadcast_to(way.max(axis=1, keepdims=True), way.shape).copy()
        for p, row in enumerate(way):
            first = int(row.argmax())
            others[p, first] = np.delete(row, first).max(initial=0.0)
        return Codebooks(entries, self.drift + (way + others) * (1 + RELATIVE))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def scaled(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """Rows (vec_id, label, v): the vectors that have no null and no non-finite component, as whole numbers."""
    x = F.col(vector_column)
    finite = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    large = F.exists(whole, lambda c: F.abs(c) > LARGEST)
    whole = F.when(large, F.raise_error(F.concat(F.lit(f"a component of more than {LARGEST // SCALE}, in the vector "), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))).otherwise(F.transform(whole, lambda c: c.cast("int")))
    return vectors.filter(finite).select(F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), whole.alias("v"))


def nearest(own: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry, the lower one of equals, and the slack to the second nearest."""
    found, slack = np.empty(len(own), np.int64), np.empty(len(own))
    for start in range(0, len(own), step := max(1, HELD // max(1, entries.size))):
        part = own[start : start + step]
        far = ((part[:, None, :] - entries[None]) ** 2).sum(axis=2)
        best = far.argmin(axis=1)
        rows = np.arange(len(part))
        least = far[rows, best]
        if far.shape[1] > 1:
            far[rows, best] = np.iinfo(np.int64).max
            slack[start : start + step] = np.sqrt(far.min(axis=1).astype(float)) - np.sqrt(least.astype(float))
        else:
            slack[start : start + step] = np.inf
        found[start : start + step] = best
    return found, slack


def keys_of(slack: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """When an entry's cumulative drift passes the key, the slack may be used up. A margin covers what rounding adds."""
    return slack * (1 - RELATIVE) - MARGIN + drift


def violated(codes: np.ndarray, keys: np.ndarray, drift: np.ndarray) -> list[int]:
    """The rows of one part's column to compare again: those popped from the heaps of their entries."""
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(drift) + 1))
    popped: list[int] = []
    for entry, passed in enumerate(drift.tolist()):
        rows = order[ends[entry] : ends[entry + 1]]
        heap = list(zip(keys[rows].tolist(), rows.tolist(), strict=True))
        heapq.heapify(heap)
        while heap and heap[0][0] <= passed:
            popped.append(heapq.heappop(heap)[1])
    return popped


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(state: DataFrame, books: Codebooks, at: str, first: bool) -> DataFrame:
    """The rows of state with their codes and keys under the codebooks, written to a folder and read back. first: they have none yet."""
    parts, _, wide = books.entries.shape
    kind = state.schema["vec_id"].dataType.simpleString(), state.schema["label"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                v = matrix(batch.column(2), parts * wide).reshape(-1, parts, wide)
                if first:
                    codes, keys = np.zeros((len(v), parts), np.int64), np.full((len(v), parts), -np.inf)
                else:
                    codes = np.array([np.frombuffer(x, np.uint8) for x in batch.column(3).to_pylist()]).astype(np.int64)
                    keys = np.array([np.frombuffer(x, np.float64) for x in batch.column(4).to_pylist()])
                for p in range(parts):
                    rows = np.arange(len(v)) if first else np.array(violated(codes[:, p], keys[:, p], books.drift[p]), np.int64)
                    codes[rows, p], slack = nearest(v[rows, p], books.entries[p])
                    keys[rows, p] = keys_of(slack, books.drift[p][codes[rows, p]])
                told = [pa.array([x.tobytes() for x in codes.astype(np.uint8)], pa.binary()), pa.array([x.tobytes() for x in keys], pa.binary())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *told], names=["vec_id", "label", "v", "codes", "keys"])

    state.mapInArrow(of, f"vec_id {kind[0]}, label {kind[1]}, v array<int>, codes binary, keys binary").write.parquet(at)
    return state.sparkSession.read.parquet(at)


def sums_of(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the parts of each entry, by position, and their numbers. A task sums up its rows; as many rows as codebooks have components are collected."""
    parts, n, wide = books.entries.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * n, wide), np.int64), np.zeros(parts * n, np.int64)
        for batch in batches:
            v = matrix(batch.column(0), parts * wide).reshape(-1, wide)
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).astype(np.int64).reshape(-1, parts) + np.arange(parts) * n
            np.add.at(sums, codes.reshape(-1), v)
            counts += np.bincount(codes.reshape(-1), minlength=parts * n)
        used = np.flatnonzero(counts)
        every = np.concatenate([counts[used, None], sums[used]], axis=1)
        place = (used[:, None] * (wide + 1) + np.arange(wide + 1)).reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(every.reshape(-1), pa.int64())], names=["place", "total"])

    found = np.zeros(parts * n * (wide + 1), np.int64)
    for row in state.select("v", "codes").mapInArrow(of, "place long, total long").groupBy("place").agg(F.sum("total").alias("total")).collect():
        found[row.place] = row.total
    found = found.reshape(parts, n, wide + 1)
    return found[:, :, 1:], found[:, :, 0]


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Rows (vec_id, label, codes, error), and the codebooks; codes has a byte for each part, error the squared distance of the vector to what its codes stand for.

    Vectors that are null, or hold null or non-finite components, have no row. All others must be of one length, a multiple of parts,
    and of no component above LARGEST / SCALE: else a ValueError or an error that names the vector. The codebooks start as the parts
    of the vectors with the smallest ids (a null id is the largest; of one id, the smaller vector comes first); where there are fewer vectors than entries, so are
    the entries. Repeated rows count as often as they come. An empty table gives no rows and no codebooks.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: between 1 and 256 entries")
    at = work_dir(spark, "codes")
    scaled(vectors, id_column, vector_column, label_column).write.parquet(f"{at}/start")
    state = spark.read.parquet(f"{at}/start")
    wide = state.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
    if wide.least is None:
        return state.select("vec_id", "label", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), None
    if wide.least != wide.most or wide.least % parts:
        raise ValueError(f"vectors have to be of one length, a multiple of {parts}: there are lengths from {wide.least} to {wide.most}")
    rows = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    start = np.array([r.v for r in rows], np.int64).reshape(len(rows), parts, wide.least // parts).transpose(1, 0, 2)
    books = Codebooks(start, np.zeros(start.shape[:2]))
    state = assigned(state, books, f"{at}/0", True)
    files.delete_folder(f"{at}/start")
    for k in range(rounds):
        books = books.moved(*sums_of(state, books))
        state = assigned(state, books, f"{at}/{k + 1}", False)
        files.delete_folder(f"{at}/{k}")
    return errors(state, books), books


def errors(state: DataFrame, books: Codebooks) -> DataFrame:
    """Rows (vec_id, label, codes, error)."""
    parts, _, wide = books.entries.shape
    kind = state.schema["vec_id"].dataType.simpleString(), state.schema["label"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(2), parts * wide).reshape(-1, parts, wide)
            codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).astype(np.int64).reshape(-1, parts)
            far = ((v - books.entries[np.arange(parts), codes]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(far, pa.int64())], names=["vec_id", "label", "codes", "error"])

    return state.select("vec_id", "label", "v", "codes").mapInArrow(of, f"vec_id {kind[0]}, label {kind[1]}, codes binary, error long")


def decoded(codes: DataFrame, books: Codebooks) -> DataFrame:
    """From rows (vec_id, codes), rows (vec_id, vector): what the codes stand for, as array<float>."""
    kind = codes.schema["vec_id"].dataType.simpleString()
    parts, _, wide = books.entries.shape

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).astype(np.int64).reshape(-1, parts)
            flat = (books.entries[np.arange(parts), own] / SCALE).astype(np.float32).reshape(len(own), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(flat), pa.list_(pa.float32()))], names=["vec_id", "vector"])

    return codes.select("vec_id", "codes").mapInArrow(of, f"vec_id {kind}, vector array<float>")


def with_label_errors(found: DataFrame) -> DataFrame:
    """Rows with label_error: the errors of all rows of the label summed up; null labels are one."""
    found = checkpointed(found)
    total = checkpointed(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    return found.join(if_few(total), F.col("label").eqNullSafe(F.col("of"))).drop("of")
