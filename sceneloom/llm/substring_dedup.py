"""Removal of repeated passages, with suffix automata of reference shards.

A window is `span` consecutive words of one document. A word goes if some window that covers it also
begins in a document with a smaller id. The method: a suffix automaton over the word sequences of a
reference shard knows all their substrings; each state keeps the smallest id among the documents that
have its strings. Documents are streamed through it, word by word, which gives at each word the longest
match that ends there (the matching statistics), and from that whether the window ending there occurs in
a smaller document. Overlapping windows make the maximal spans that are removed.

To broadcast automata of all documents and stream all documents through each would cost the square
of the corpus. So shards are formed by content. Each window has an anchor, the run of words in it
with the smallest hash; equal windows have equal anchors. Neighbouring windows with one anchor are a stretch
of text. Only anchors of two documents or more matter; a bitmap of their hashes, of MOST_BITS at most, is
broadcast, and stretches whose anchor is in it are sent to the anchor's shard. So all copies of a
window meet in one shard, whose automaton is built of, and streamed with, the shard's own distinct stretches;
every window of a shared anchor is judged by an automaton. Equal stretches are one row, with the smallest id, before they are sent, so copies of a
document cost nothing more. A shard takes anchors until it has SHARD_WORDS words. An anchor of more than MOST_STRETCHES distinct
stretches is too large for one: its stretches are cut again, by longer anchors, and sent to finer shards, down to anchors
that are whole windows, of which a shard has one each. So no shard is large, however often its words come.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, hashed_words, if_few, text_slices, whole_number_ids, work_dir
from .minhash import mixed

#: Words of a window, and of its anchor.
SPAN, ANCHOR = 50, 16
#: Distinct stretches that an anchor's shard holds at most, and words that a shard has before it is closed.
MOST_STRETCHES, SHARD_WORDS = 512, 20_000
#: Rows that hold one stretch, from which on they are not joined by a shuffle.
MOST_HELD = 2000
#: Stretches that a task remembers to have sent with their words.
REMEMBERED = 1_000_000
#: Bits of the bitmap of repeated anchors: SPARSE for each of those, as a power of two, between these. At 128 MB it may fill up at
#: very large inputs; then more stretches are sent, no others judged.
SPARSE, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30
#: Bytes of text that are taken at a time, and rows where those are few.
TEXT_BYTES, BATCH = 4 << 20, 128
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class SuffixAutomaton:
    """All substrings of several word sequences, each state with the smallest id of a sequence that has it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.smallest = [-1], [0], [np.iinfo(np.int64).max]

    def add(self, words: list[int], doc_id: int) -> None:
        """Adds a sequence. Its states get the id by finish()."""
        following, link, length, smallest = self.next, self.link, self.length, self.smallest
        last = 0
        for word in words:
            there = following[last].get(word)
            if there is not None and length[there] == length[last] + 1:
                last = there
                if doc_id < smallest[last]:
                    smallest[last] = doc_id
                continue
            if there is not None:
                last = self._split(last, word, there)
                if doc_id < smallest[last]:
                    smallest[last] = doc_id
                continue
            new = len(following)
            following.append({})
            length.append(length[last] + 1)
            link.append(0)
            smallest.append(doc_id)
            at = last
            while at >= 0 and word not in following[at]:
                following[at][word] = new
                at = link[at]
            if at >= 0:
                there = following[at][word]
                link[new] = there if length[there] == length[at] + 1 else self._split(at, word, there)
            last = new

    def _split(self, at: int, word: int, there: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[there]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[there])
        self.smallest.append(self.smallest[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def finish(self) -> None:
        """Passes ids on from longer strings to their suffixes."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up >= 0 and self.smallest[state] < self.smallest[up]:
                self.smallest[up] = self.smallest[state]

    def smallest_of_windows(self, words: list[int], span: int) -> list[int]:
        """For each window of span words, by its beginning, the smallest id of a sequence that has it."""
        following, link, length, smallest = self.next, self.link, self.length, self.smallest
        out, at, matched = [], 0, 0
        for i, word in enumerate(words):
            while at and word not in following[at]:
                at = link[at]
                matched = length[at]
            if word in following[at]:
                at = following[at][word]
                matched += 1
            while at and length[link[at]] >= span:
                at = link[at]
                matched = length[at]
            if i >= span - 1:
                out.append(smallest[at] if matched >= span else np.iinfo(np.int64).max)
        return out


def run_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of size words."""
    n = max(0, len(hashes) - size + 1)
    found = np.full(n, size + seed, np.uint64)
    for k in range(size):
        found = (found ^ (found >> np.uint64(29))) * _MIX1 + hashes[k : k + n]
    return mixed(found)


def anchors(hashes: np.ndarray, span: int, anchor: int) -> np.ndarray:
    """For the windows of span words, the smallest hash of a run of anchor words in each."""
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    runs, width = run_hashes(hashes, anchor), span - anchor + 1
    # The smallest of each `width` neighbours: by blocks, from the left and from the right.
    padded = np.full(-(-len(runs) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(runs)] = runs
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def stretches(texts: pa.Array, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch the text, first window, number of windows and anchor."""
    flat, sizes = hashed_words(texts)
    least = anchors(flat, span, anchor)
    of = np.repeat(np.arange(len(sizes)), sizes)[: len(least)]
    ends = np.cumsum(sizes)
    inside = np.flatnonzero(np.arange(len(least)) + span <= ends[of])
    if not len(inside):
        return tuple([np.empty(0, np.int64)] * 4)
    new = np.flatnonzero((np.diff(inside) != 1) | (np.diff(least[inside]) != 0) | (np.diff(of[inside]) != 0)) + 1
    first = inside[np.concatenate([[0], new])]
    n = np.diff(np.concatenate([[0], new, [len(inside)]]))
    return of[first], first - (ends - sizes)[of[first]], n, least[first].astype(np.int64)


def removals(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """Rows (doc_id, tie, begin, before): ranges of words to remove; tie is xxhash64 of the text. docs has doc_id (long, not null) and text."""
    spark = docs.sparkSession

    def slices(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for start, n in text_slices(batch.column(1), TEXT_BYTES):
                part = batch.slice(start, n)
                yield part.column(0).to_numpy(zero_copy_only=False), part.column(1), stretches(part.column(1), span, anchor)

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, (of, _, _, found) in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(ids[of], pa.int64())], names=["anchor", "doc_id"])

    repeated = docs.mapInArrow(anchored, "anchor long, doc_id long").groupBy("anchor").agg(F.min("doc_id").alias("one"), F.max("doc_id").alias("other")).filter("one < other")
    repeated = checkpointed(repeated.select("anchor"))
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (SPARSE * repeated.count()).bit_length()))
    place = F.pmod(F.col("anchor"), F.lit(n_bits)) + 1  # Spark numbers places from 1
    bitmap = repeated.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(n_bits // 8, np.uint8)
    for row in bitmap.toLocalIterator():  # n_bits / 8 bytes at most
        bits[(row.bucket - 1) * 4096 : row.bucket * 4096] |= np.frombuffer(row.bits, np.uint8)[: max(0, len(bits) - (row.bucket - 1) * 4096)]
    sent = spark.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for ids, own, (of, first, n, found) in slices(batches):
            at = found % n_bits
            keep = np.flatnonzero(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            texts, digests, ties, last, words, tie = [], [], [], None, [], 0
            for k in keep.tolist():  # the stretches of a text come one after the other
                if of[k] != last:
                    last, text = of[k], own[int(of[k])].as_py().encode()
                    words, tie = text.split(), xxhash.xxh64_intdigest(text, 42)
                text = b" ".join(words[first[k] : first[k] + n[k] + span - 1])
                digests.append(digest := xxhash.xxh128_digest(text))
                texts.append(None if digest in told else text)  # the words of a stretch are sent once by a task
                ties.append(tie)
                if len(told) >= REMEMBERED:
                    told.clear()
                told.add(digest)
            ties = np.array(ties, np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[of[keep]], pa.int64()), pa.array(ties, pa.int64()), pa.array(found[keep], pa.int64()), pa.array(digests, pa.binary()), pa.array(first[keep], pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "tie", "anchor", "stretch", "first", "words"])

    at = work_dir(spark, "passages")
    docs.mapInArrow(cut, "doc_id long, tie long, anchor long, stretch binary, first long, words binary").write.option("compression", "zstd").parquet(f"{at}/found")
    found = spark.read.parquet(f"{at}/found")
    spans = with_runs(found.drop("words"), *judged(found.select("anchor", "stretch", "doc_id", "words"), span, anchor, f"{at}/distinct")).filter("smallest < doc_id")
    return spans.select("doc_id", "tie", (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("before") + span - 1).alias("before"))


def judged(found: DataFrame, span: int, anchor: int, at: str) -> tuple[DataFrame, DataFrame]:
    """From rows (anchor, stretch, doc_id, words), rows (anchor, stretch, begin, before, smallest): of each distinct stretch, runs of windows of one smallest id. And the stretches with held, how many rows have them.

    Of several rows of one stretch, some may have null words. anchor is the length of the anchors.
    """
    spark = found.sparkSession
    found.groupBy("anchor", "stretch").agg(F.min("doc_id").alias("owner"), F.first("words", ignorenulls=True).alias("words"), F.count(F.lit(1)).alias("held")).write.option("compression", "zstd").parquet(at)
    distinct = spark.read.parquet(at)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple[int, bytes, int, list[int]]] = []
        numbers: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            automaton = SuffixAutomaton()
            for _, _, owner, words in shard:
                automaton.add(words, owner)
            automaton.finish()
            out: list[tuple[int, bytes, int, int, int]] = []
            for anchor_, stretch, _, words in shard:
                smallest, begin = automaton.smallest_of_windows(words, span), 0
                for i in range(1, len(smallest) + 1):
                    if i == len(smallest) or smallest[i] != smallest[begin]:
                        out.append((anchor_, stretch, begin, i, smallest[begin]))
                        begin = i
            shard.clear()
            numbers.clear()
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["anchor", "stretch", "begin", "before", "smallest"])

        n = 0
        for batch in batches:
            for anchor_, stretch, owner, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= SHARD_WORDS and shard[-1][0] != anchor_:
                    yield flush()
                    n = 0
                words = [numbers.setdefault(w, len(numbers)) for w in text.split(b" ")]
                shard.append((anchor_, stretch, owner, words))
                n += len(words)
        yield flush()

    columns = ["anchor", "stretch", "owner", "words"]
    kind = "anchor long, stretch binary, begin long, before long, smallest long"
    alike = distinct.select(columns)
    if anchor == span:
        return alike.repartition("anchor").sortWithinPartitions("anchor", "owner").mapInArrow(matched, kind), distinct
    # Of these anchors there are as many as stretches, divided by MOST_STRETCHES, at most.
    crowded = if_few(checkpointed(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > MOST_STRETCHES).select("anchor")))
    runs = alike.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "owner", "stretch").mapInArrow(matched, kind)
    longer = min(span, 2 * anchor + 1)

    def cut_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH):
                part = batch.slice(k, BATCH)
                of, first, n, finer = stretches(part.column(3).cast(pa.string()), span, longer)
                texts, last, words = [], None, []
                for i in range(len(of)):
                    if of[i] != last:
                        last, words = of[i], part.column(3)[int(of[i])].as_py().split(b" ")
                    texts.append(b" ".join(words[first[i] : first[i] + n[i] + span - 1]))
                of = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), part.column(2).take(of), pa.array(first, pa.int64()), pa.array(finer, pa.int64()), pa.array([xxhash.xxh128_digest(t) for t in texts], pa.binary()), pa.array(texts, pa.binary())], names=["of_anchor", "of_stretch", "doc_id", "first", "anchor", "stretch", "words"])

    again = alike.join(crowded, "anchor", "left_semi").mapInArrow(cut_again, "of_anchor long, of_stretch binary, doc_id long, first long, anchor long, stretch binary, words binary")
    if crowded.isEmpty():
        return runs, distinct
    again.write.option("compression", "zstd").parquet(f"{at}-again")
    again = spark.read.parquet(f"{at}-again")
    finer = with_runs(again.drop("words", "doc_id"), *judged(again.select("anchor", "stretch", "doc_id", "words"), span, longer, f"{at}-{longer}"))
    return runs.unionByName(finer.select(F.col("of_anchor").alias("anchor"), F.col("of_stretch").alias("stretch"), (F.col("first") + F.col("begin")).alias("begin"), (F.col("first") + F.col("before")).alias("before"), "smallest")), distinct


def with_runs(found: DataFrame, runs: DataFrame, distinct: DataFrame) -> DataFrame:
    """found joined with the runs of its stretches. Those that very many rows hold are few, a part in MOST_HELD of all at most, and go to all tasks."""
    by = ["anchor", "stretch"]
    runs = checkpointed(runs)
    hot = if_few(checkpointed(distinct.filter(F.col("held") > MOST_HELD).select(by)))
    of_hot = if_few(checkpointed(runs.join(hot, by, "left_semi")))
    return found.join(of_hot, by).unionByName(found.join(hot, by, "left_anti").join(runs.join(hot, by, "left_anti"), by))


def remove_repeated(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept), one for each row of docs; kept is the words that stay, with one space between.

    Words are runs of anything but ASCII white space, unchanged. A null or empty text has no words. Windows are
    judged on the input. A row of a null id is smaller than none and loses nothing; rows of one id don't judge each other, and each
    loses what its own words repeat of smaller ids. An
    empty table gives an empty result. Ids have to be whole numbers. Other columns are not carried.
    """
    whole_number_ids(docs, id_column)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    spans = removals(own.filter("doc_id is not null"), span, anchor)
    # Rows are told apart by id and text; those equal in both share their spans, which are fewer than their words.
    spans = spans.groupBy(F.col("doc_id").alias("of"), "tie").agg(F.collect_set(F.struct("begin", "before")).alias("spans"))
    # Rows of a null id have no spans; each goes to a task of its own choice.
    same = (F.coalesce("doc_id", F.xxhash64("text")) == F.col("of")) & (F.xxhash64("text") == F.col("tie")) & F.col("doc_id").isNotNull()
    joined = own.join(spans, same, "left").select("doc_id", "text", F.col("spans.begin").alias("begin"), F.col("spans.before").alias("before"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                n_words, n_removed, kept = [], [], []
                for text, begins, befores in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    words = text.encode().split() if text else []
                    gone = np.zeros(len(words) + 1, np.int64)
                    if begins:
                        np.add.at(gone, np.minimum(begins, len(words)), 1)
                        np.add.at(gone, np.minimum(befores, len(words)), -1)
                    stay = np.flatnonzero(np.cumsum(gone)[: len(words)] == 0)
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(stay))
                    kept.append(b" ".join([words[k] for k in stay] if begins else words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(of, "doc_id long, n_words long, n_removed long, kept string")
