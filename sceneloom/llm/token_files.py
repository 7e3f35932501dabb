"""Token ids in binary files: frequency-ranked, byte-aligned, with separate control bytes.

Pass 1 encodes every document once and keeps its ids, as the tokenizer gives them, in a table in the
shared folder. The ids are counted there and the vocabulary is ranked, the most frequent first. Pass 2
puts the encoded documents in ascending order of their ids and writes one file a partition; texts are not
moved. In a file an id stands as its rank, in as few bytes as the rank needs, one to four; the lengths are
apart, two bits each, four to a control byte. A reader takes all lengths from a table of the 256 control
bytes, and all ids from the byte stream with numpy, without a loop over ids.

A file is a sequence of blocks of up to BLOCK documents, less where they are long:

    magic b"LOOMIDS1" | u32 documents | u64 ids | u64 data bytes
    i64 document id, each | u8 whether that id is null, each | u64 ids of the document, each
    control bytes, a quarter of the ids, rounded up | data bytes

Only the vocabulary's counts (one row a token) and one row a file reach the driver.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import files
from .common import text_slices, whole_number_ids

MAGIC, HEAD = b"LOOMIDS1", struct.Struct("<8sIQQ")
#: Documents of a block, and ids from which on it takes no more; a block's ids are what a reader or writer holds at once.
BLOCK, BLOCK_IDS = 256, 1 << 20
#: Bytes of text that are encoded at once, or one text if that is longer.
TEXT_BYTES = 6 << 20
#: So many distinct words are remembered in a Python worker twice: those used last, and those used before them.
REMEMBERED = 300_000
# The normaliser and the pre-tokenizer that Encoder knows to look at one word at a time.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
KNOWN_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# Words that are a run of Latin letters, whose lower case is one letter each and which no normal form changes, with
# ASCII marks after it, and those marks. An apostrophe is none of them, as it may belong to the letters after it.
LETTERS, MARKS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = LETTERS + r"[!-&(-/:-@\[-`{-~]*$"
#: Words that are given to the library as one text.
JOINED = 500

#: For each control byte the lengths of its four numbers: 1 to 4, from the lowest two bits up.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def looks_at_words(settings: dict) -> bool:
    """Whether a tokenizer file gives a text the ids of its words, one after the other, whatever stands beside them.

    It does if it is one that parts letters, digits and marks after putting all in lower case, and nothing is cut,
    padded or added. Its BPE model then gives a run of letters the same ids in any text.
    """
    plain = all(not t["normalized"] and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in settings["added_tokens"])
    model = settings["model"]
    same = settings["normalizer"] == KNOWN_NORMALIZER and settings["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [KNOWN_SPLIT, KNOWN_BYTES]}
    return plain and same and model["type"] == "BPE" and not model["dropout"] and not settings["truncation"] and not settings["padding"] and not settings["post_processor"]


class Remembered:
    """Ids of distinct words, end to end, and where each word's are."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, "<u4")

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])

    def get(self, words: list[str]) -> np.ndarray:
        """The numbers of words, -1 for those that are not known."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def take(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids words of these numbers have, and all of those."""
        return taken(self.starts, self.flat, numbers)


def taken(starts: np.ndarray, flat: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of some of the runs that flat holds end to end, and those runs end to end. starts ends with the end."""
    begin = starts[numbers]
    n = starts[numbers + 1] - begin
    until = np.cumsum(n)
    return n, flat[np.arange(until[-1] if len(until) else 0) + np.repeat(begin - (until - n), n)]


class Encoder:
    """Encodes texts with a tokenizer of the tokenizers library, each distinct word once where looks_at_words() holds.

    A word of PLAIN has the ids of its letters in lower case, which go to the model as they are, and then those of
    its marks. All other words, and whole texts under any other tokenizer, are given to the library unchanged.
    """

    def __init__(self, path: str, end_id: int, by_word: bool | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as found:
            settings = json.load(found)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = looks_at_words(settings) if by_word is None else by_word
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(*vocabulary.values(), end_id) + 1
        self.end_id = end_id
        if self.by_word:
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            #: Whether an id is the last one of a run of letters.
            self.last = np.zeros(self.size, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(settings["model"]["end_of_word_suffix"])]] = True
        self.recent, self.before = Remembered(), Remembered()

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids end to end, just as the library gives them."""
        found = [x.ids for start in range(0, len(texts), 4096) for x in self.tokenizer.encode_batch_fast(texts[start : start + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), "<u4", int(sizes.sum()))

    def of_letters(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of lower-case letters, many of which are one text to the library. An empty one has no ids."""
        real = [x for x in runs if x]
        joined = [" ".join(real[start : start + JOINED]) for start in range(0, len(real), JOINED)]
        found = [x.ids for x in self.letters.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), "<u4", sum(map(len, found)))
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(real):  # a run has an end that the model does not know
            return self.of_texts(runs)
        sizes = np.zeros(len(runs), np.int64)
        sizes[[i for i, x in enumerate(runs) if x]] = np.diff(ends, prepend=0)
        return sizes, ids

    def looked_up(self, words: pa.Array, of) -> np.ndarray:
        """The numbers in self.recent of distinct words, of which `of` encodes what is new."""
        words = words.to_pylist()
        numbers = self.recent.get(words)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            wanted = [words[i] for i in missing]
            old = self.before.get(wanted)
            again, new = np.flatnonzero(old >= 0), np.flatnonzero(old < 0)
            for at, (sizes, ids) in ((again, self.before.take(old[again])), (new, of([wanted[i] for i in new]))):
                numbers[missing[at]] = len(self.recent.number) + np.arange(len(at))
                self.recent.add([wanted[i] for i in at], sizes, ids)
        return numbers

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts, each text's followed by the end id, end to end; and how many each text has.

        A null or empty text has only the end id.
        """
        texts = texts.fill_null("")
        if not self.by_word:
            sizes, ids = self.of_texts(texts.to_pylist())
            return np.insert(ids, np.cumsum(sizes), self.end_id), sizes + 1
        if len(self.recent.number) >= REMEMBERED:
            self.recent, self.before = Remembered(), self.recent
        split = pc.ascii_split_whitespace(texts)
        n_words = split.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary
        # Each distinct word is a run of letters, or nothing, and what comes after that.
        plain = pc.match_substring_regex(words, PLAIN)
        letters = pc.utf8_lower(pc.if_else(plain, pc.ascii_rtrim(words, MARKS), "")).dictionary_encode()
        rest = pc.if_else(plain, pc.replace_substring_regex(words, LETTERS, ""), words).dictionary_encode()
        own = [self.looked_up(part.dictionary, of)[part.indices.to_numpy(zero_copy_only=False)] for part, of in ((letters, self.of_letters), (rest, self.of_texts))]
        sizes, ids = self.recent.take(np.stack(own, axis=1).reshape(-1))
        starts = np.concatenate([[0], np.cumsum(sizes.reshape(-1, 2).sum(axis=1))])
        # The end id stands as one more word of each text.
        starts, ids = np.append(starts, starts[-1] + 1), np.append(ids, np.uint32(self.end_id))
        codes = np.full(len(numbered) + len(texts), len(words), np.int64)
        ends = np.cumsum(n_words + 1) - 1
        is_word = np.ones(len(codes), bool)
        is_word[ends] = False
        codes[is_word] = numbered.indices.to_numpy(zero_copy_only=False)
        n, found = taken(starts, ids, codes)
        return found, np.diff(np.cumsum(n)[ends], prepend=0)


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit numbers."""
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    in_use = np.arange(4) < lengths[:, None]
    return np.bitwise_or.reduce(control, axis=1).astype(np.uint8).tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[in_use].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of pack()."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    found = np.frombuffer(data, np.uint8)
    out = found[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        out[longer] |= found[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_block(out: BinaryIO, doc_ids: list[int | None], ids: list[np.ndarray], rank_of: np.ndarray) -> int:
    """Writes one block; the number of its ids."""
    ranks = rank_of[np.concatenate(ids)]
    control, data = pack(ranks)
    out.write(HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data)))
    out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.write(np.array([x is None for x in doc_ids], np.uint8).tobytes())
    out.write(np.array([len(x) for x in ids], "<u8").tobytes())
    out.write(control)
    out.write(data)
    return len(ranks)


def read_blocks(found: BinaryIO, id_of: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
    """The documents of a file in their order, each with its ids."""
    while head := found.read(HEAD.size):
        magic, n_docs, n_ids, n_data = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("this is no file of token ids")
        doc_ids, null = np.frombuffer(found.read(8 * n_docs), "<i8"), np.frombuffer(found.read(n_docs), np.uint8)
        ends = np.cumsum(np.frombuffer(found.read(8 * n_docs), "<u8").astype(np.int64))
        ids = id_of[unpack(found.read(-(-n_ids // 4)), found.read(n_data), n_ids)]
        for i, own in enumerate(np.split(ids, ends[:-1])):
            yield None if null[i] else int(doc_ids[i]), own


def encode(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, np.dtype, int]:
    """Rows (id, tie, ids), one for each row of docs, in the folder; the numbers that ids are made of, and how many ids there may be.

    tie is a hash of the text, which parts rows of one id.
    """
    whole_number_ids(docs, id_column)
    size = encoder(tokenizer_path, end_id).size
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path, end_id)
        for batch in batches:
            for start, n in text_slices(batch.column(2), TEXT_BYTES):
                part = batch.slice(start, n)
                ids, counts = own.ids(part.column(2))
                ends = np.concatenate([[0], np.cumsum(counts * kind.itemsize)])
                packed = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=["id", "tie", "ids"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("tie"), F.col(text_column).cast("string").alias("text"))
    rows.mapInArrow(of, "id long, tie long, ids binary").write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder), kind, size


def ranks(encoded: DataFrame, kind: np.dtype, size: int) -> np.ndarray:
    """The vocabulary's ids, the most frequent in all documents first, ties by id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                counts += np.bincount(np.frombuffer(ids.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "n"])

    counted = encoded.select("ids").mapInArrow(of, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, np.int64)
    for row in counted.collect():  # one row a token of the vocabulary at most
        counts[row.id] = row.n
    return np.lexsort((np.arange(size), -counts)).astype("<u4")


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> list[tuple[str, int]]:
    """Writes all documents in ascending order of their ids; the files in their order, with the ids in each.

    Each text is followed by end_id; a null or empty text has only that. Documents of a null id come first;
    those of equal ids in an order of their texts. An empty table makes no file with documents. The file
    vocabulary.u4 in the folder holds the ranked ids. Ids have to be whole numbers; other columns are not carried.
    """
    files.make_folder(folder)
    encoded, kind, size = encode(docs, f"{folder}/encoded", tokenizer_path, end_id, id_column, text_column)
    id_of = ranks(encoded, kind, size)
    with files.writing(f"{folder}/vocabulary.u4") as out:
        out.write(id_of.tobytes())
    rank_of = np.empty(len(id_of), np.uint32)
    rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
    sent = docs.sparkSession.sparkContext.broadcast(rank_of)  # four bytes a token of the vocabulary

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        name = f"{folder}/part-{part:06d}.ids"
        with files.writing(name) as out:
            doc_ids: list[int | None] = []
            held: list[np.ndarray] = []
            n_held = 0
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    doc_ids.append(doc_id)
                    held.append(np.frombuffer(ids.as_buffer(), kind))
                    n_held += len(held[-1])
                    if len(held) == BLOCK or n_held >= BLOCK_IDS:
                        n += write_block(out, doc_ids, held, sent.value)
                        doc_ids, held, n_held = [], [], 0
            if held:
                n += write_block(out, doc_ids, held, sent.value)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([name]), pa.array([n], pa.int64())], names=["part", "file", "n"])

    # The hash lets a range end inside the rows of one id, so that such rows need not meet in one task.
    ordered = encoded.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")
    made = ordered.mapInArrow(of, "part long, file string, n long").collect()  # one row a file
    files.delete_folder(f"{folder}/encoded")
    return [(row.file, row.n) for row in sorted(made) if row.n]


def read(spark: SparkSession, folder: str, written: Iterable[tuple[str, int]]) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from the files; start counts the ids of all documents before."""
    with files.reading(f"{folder}/vocabulary.u4") as found:
        sent = spark.sparkContext.broadcast(np.frombuffer(found.read(), "<u4"))
    rows, before = [], 0
    for name, n in written:
        rows.append((name, before))
        before += n

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.reading(name) as found:
                    out: list[tuple[int | None, int, np.ndarray]] = []
                    for doc_id, ids in read_blocks(found, sent.value):
                        out.append((doc_id, start, ids))
                        start += len(ids)
                        if len(out) == BLOCK:
                            yield _records(out)
                            out = []
                    yield _records(out)

    parts = spark.createDataFrame(rows, "file string, start long").repartition(max(1, len(rows)))
    return parts.mapInArrow(of, "doc_id long, start long, n_tokens long, ids binary")


def _records(rows: list[tuple[int | None, int, np.ndarray]]) -> pa.RecordBatch:
    columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([len(x[2]) for x in rows], pa.int64()), pa.array([x[2].astype("<u4").tobytes() for x in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
