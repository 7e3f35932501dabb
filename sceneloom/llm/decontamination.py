"""Benchmark decontamination with an Aho-Corasick automaton.

The benchmark texts are normalised to words, and every window of WINDOW words becomes one pattern, as
does a shorter item as a whole. One automaton over all patterns goes through each normalised document
once and reports every window that it holds; the words found are mapped back to places in the original text.

What the automaton is built from is broadcast, so it is checked: a benchmark above `part_bytes` is cut into
parts, which are kept in the shared folder. A task then builds an automaton of one part after the other, each for
CHUNK_BYTES of texts, so it holds one at a time, and puts together what they find in each row. Texts are read once and
scanned in the task that reads them; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, functions as F

from . import files
from .common import text_slices, without, work_dir

#: Words of a window.
WINDOW = 10
#: Bytes of benchmark text for one automaton; one takes about 300 times that in memory.
PART_BYTES = 1 << 20
#: Bytes of texts that all parts go over before the next texts are taken; fewer if there is one part.
CHUNK_BYTES, ONE_PART_BYTES = 64 << 20, 4 << 20

#: Bytes that are no part of a word become spaces, A to Z lower case. All bytes of characters beyond ASCII are word bytes.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return text.encode().translate(TO_WORDS).split() if text else []


def patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[bytes, tuple[int, set[str]]]:
    """For each window, as its words with spaces between and around, its number of words and its items."""
    found: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            part = words[i : i + window]
            ids = found.setdefault(b" " + b" ".join(part) + b" ", (len(part), set()))[1]
            if item is not None:
                ids.add(str(item))
    return found


def automaton(found: dict[bytes, tuple[int, set[str]]]):
    """The automaton over the patterns. Bytes stand as the characters of those numbers."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for pattern, (n, ids) in found.items():
        made.add_word(pattern.decode("latin-1"), (len(pattern), n, tuple(ids)))
    made.make_automaton()
    return made


def line_of(words: list[bytes]) -> str:
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def scan(line: str, made) -> tuple[list[tuple[int, int]], set[str]]:
    """The hit words as disjoint ranges from and before, and the items found."""
    # Where a window begins, in words, follows from the spaces before it; they are counted from one hit to the next.
    ranges: list[tuple[int, int]] = []
    items: set[str] = set()
    at = counted = 0
    hits = sorted((end - length + 1, n, ids) for end, (length, n, ids) in made.iter(line)) if len(made) else []
    for begin, n, ids in hits:
        counted += line.count(" ", at, begin)
        at = begin
        items.update(ids)
        ranges.append((counted, counted + n))
    return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for begin, before in ranges:
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], before))
        else:
            out.append((begin, before))
    return out


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges of words as ranges of characters of the original text."""
    if not ranges:
        return []
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(spans[a][0], spans[b - 1][1]) for a, b in ranges]


def find_windows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, tie (a hash of the text), n_words, hits, spans and items.

    hits holds the ranges of words (from, before) inside windows of the benchmark, disjoint and in order,
    spans the same as characters of the original text, items the ids, as strings and sorted, of the
    items with such windows. A null or empty text, or one without words, has no hits, as have all texts
    if the benchmark is empty or has no words. Items of a null id hit, but are not listed; items of one
    id count as one. Other columns are not carried. Ids of docs may repeat or be null.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text_column).cast("string").alias("text"))
    n_parts = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    if n_parts == 1:
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])  # part_bytes of text at most
    else:
        at = work_dir(spark, "benchmark")
        items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)).cast("int")).repartition("part").write.partitionBy("part").parquet(at)
        found = sorted(r.file for r in spark.read.parquet(at).select(F.input_file_name().alias("file")).distinct().collect())  # a file or few a part
        sent = spark.sparkContext.broadcast(found)

    def automata() -> Iterator[object]:
        if n_parts == 1:
            yield automaton(patterns(sent.value, window))
            return
        for name in sent.value:
            with files.reading(name) as opened:
                rows = pq.read_table(opened, columns=["item", "text"]).to_pydict()
            yield automaton(patterns(list(zip(rows["item"], rows["text"], strict=True)), window))

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, tie long, n_words long, hits array<struct<a:long,b:long>>, spans array<struct<a:long,b:long>>, items array<string>"
    pair = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = list(automata()) if n_parts == 1 else None
        for batch in batches:
            for start, n in text_slices(batch.column(2), CHUNK_BYTES if only is None else ONE_PART_BYTES):
                own = batch.slice(start, n)
                texts = own.column(2).to_pylist()
                words = [words_of(text) for text in texts]
                n_words, lines = [len(w) for w in words], [line_of(w) if w else "" for w in words]
                del words
                hits: list[list[tuple[int, int]]] = [[] for _ in texts]
                names: list[set[str]] = [set() for _ in texts]
                for made in only or automata():
                    for i, line in enumerate(lines):
                        if line:
                            ranges, ids = scan(line, made)
                            hits[i] = merged(sorted(hits[i] + ranges)) if hits[i] and ranges else hits[i] or ranges
                            names[i] |= ids
                pairs = lambda every: pa.array([[{"a": a, "b": b} for a, b in x] for x in every], pair)
                spans = [offsets(text, ranges) for text, ranges in zip(texts, hits, strict=True)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n_words, pa.int64()), pairs(hits), pairs(spans), pa.array([sorted(x) for x in names], pa.list_(pa.string()))], names=["doc_id", "tie", "n_words", "hits", "spans", "items"])

    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("tie"), F.col(text_column).cast("string").alias("text")).mapInArrow(of, schema)


def n_hit() -> F.Column:
    """The number of hit words, from hits."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs without the rows that have a hit. Each row stands or falls by its own text, whether its id is repeated, null or neither."""
    found = find_windows(docs, benchmark, id_column=id_column, text_column=text_column, **options)
    return without(docs, found.filter(F.size("hits") > 0), id_column, text_column)
