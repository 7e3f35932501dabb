"""Near duplicates by MinHash with tensored banding; every link is confirmed on the full sets.

Each set gets two small collections of HALVES half-bands of ROWS minhashes. Every pair of a half-band of the
first and one of the second is a table key, so HALVES**2 tables of 2 * ROWS minhashes cost but
2 * HALVES * ROWS minhashes a set, about the square root of what independent tables would. Two sets of
similarity s share no key with chance below 2 * (1 - s**ROWS)**HALVES: 4e-4 at s = 0.8, 2e-5 at 0.85.

Equal sets are made one class first. Of each table's bucket, every class is compared with the smallest
(the lead); links make components. Then members of one bucket whose components differ are compared
too, so that no link between components is missed: with a few of the bucket's largest component first. Of what stays apart, two sets can only be
linked if they share one of their rarest shingles: in any common order of all shingles, of a set of n those before the last
ceil(n * similar) - 1. So only pairs that share such a shingle, share a bucket, and whose sizes allow a link are compared; documents of one
template, which share what is common, are not. The order is by a sketch of how often shingles come, whose size is bounded. Sets that share a rare shingle with more
than MOST_SHARED others are compared in blocks, of which only links come out. So a group of n copies costs n comparisons,
not n * n, and none of its links that matters is lost. Buckets are only ever counted or joined, never gathered. Shingles are
hashed once for the tables and once for the sets that meet; comparisons read sets, not texts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpointed, free_name, hashed_words, if_few, text_slices, work_dir

HALVES, ROWS = 12, 3
#: Percent of the union that the intersection has to be.
SIMILAR = 80
#: So often members outside a bucket's largest component are compared with one member of that, before all are.
PIVOT_TURNS = 2
#: Links that one task of a step towards components is given; so many at most are solved in one.
LINKS_OF_TASK = 200_000
#: Rows of a block, of which two are compared in a task.
BLOCK = 256
#: Sets that share one of their rarest shingles, from which on they are compared in blocks.
MOST_SHARED = 64
#: Counts in the sketch of shingles: a power of two, one for each two shingles of the sets that are left, between these.
LEAST_COUNTS, MOST_COUNTS = 1 << 12, 1 << 21
#: Bytes of text that are taken at a time.
TEXT_BYTES = 4 << 20
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX1
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return x ^ (x >> np.uint64(32))


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of runs of `size` words, from the hashes of the words. Fewer words make one run, none make none."""
    if not len(hashes):
        return hashes
    n, width = max(1, len(hashes) - size + 1), min(size, len(hashes))
    found = np.full(n, width, np.uint64)
    for k in range(width):
        found = mixed(found * _MIX2 + hashes[k : k + n])
    return np.unique(found)


class Signer:
    """Minhashes, and the half-bands made of them."""

    def __init__(self, halves: int, rows: int, seed: int):
        draw = np.random.default_rng(seed)
        self.halves, self.rows = halves, rows
        self.factor = draw.integers(0, 2**63, 2 * halves * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.offset = draw.integers(0, 2**63, 2 * halves * rows, np.uint64)

    def bands(self, found: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(found), 2048):
            part = found[start : start + 2048, None] * self.factor + self.offset
            least = np.minimum(least, (part ^ (part >> np.uint64(33))).min(axis=0))
        band = np.arange(2 * self.halves, dtype=np.uint64)
        for values in least.reshape(2 * self.halves, self.rows).T:
            band = mixed(band * _MIX1 + values)
        return band


def signed(docs: DataFrame, id_column: str, text_column: str, size: int, halves: int, rows: int, seed: int) -> DataFrame:
    """Rows (doc_id, n_shingles, set_1, set_2, first, second): two hashes of the set, and its half-bands."""
    kind = docs.schema[id_column].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(halves, rows, seed)
        signs = pa.list_(pa.int64())
        for batch in batches:
            for start, length in text_slices(batch.column(1), TEXT_BYTES):
                part = batch.slice(start, length)
                n, one, two, first, second = [], [], [], [], []
                words, sizes = hashed_words(part.column(1), lower=True)
                for own in np.split(words, np.cumsum(sizes)[:-1]):
                    found = runs(own, size)
                    n.append(len(found))
                    one.append(int(np.add.reduce(mixed(found ^ _MIX2)).astype(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mixed(found + _MIX1)).astype(np.int64)))
                    bands = signer.bands(found).astype(np.int64) if len(found) else np.empty(0, np.int64)
                    first.append(bands[:halves])
                    second.append(bands[halves:])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(first, signs), pa.array(second, signs)], names=["doc_id", "n_shingles", "set_1", "set_2", "first", "second"])

    return docs.select(id_column, F.col(text_column).cast("string")).mapInArrow(of, f"doc_id {kind}, n_shingles long, set_1 long, set_2 long, first array<long>, second array<long>")


def keys(signs: DataFrame, halves: int) -> DataFrame:
    """Rows (key, doc_id, n): the table keys of each class that meets another in a half-band of the first collection.

    A class that meets none there shares no key with any other.
    """
    half = signs.select("doc_id", "n", "second", F.posexplode("first").alias("i", "band"))
    met = half.groupBy("i", "band").agg(F.count(F.lit(1)).alias("several")).filter("several > 1").select("i", "band")
    half = half.join(met, ["i", "band"])
    return half.select("doc_id", "n", "i", "band", F.posexplode("second").alias("j", "other")).select(F.xxhash64("i", "band", "j", "other").alias("key"), "doc_id", "n")


def within(ids: DataFrame, docs: DataFrame, id_column: str) -> DataFrame:
    """The rows of docs whose id is in ids (one column, id). ids are broadcast if they are few, which is counted."""
    return docs.join(if_few(ids), F.col(id_column) == F.col("id"), "left_semi")


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """From rows (id, text), rows (id, shingles): the sorted hashes of each text's set, as bytes."""
    kind = texts.schema["id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, length in text_slices(batch.column(1), TEXT_BYTES):
                part = batch.slice(start, length)
                words, sizes = hashed_words(part.column(1), lower=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([runs(own, size).tobytes() for own in np.split(words, np.cumsum(sizes)[:-1])], pa.binary())], names=["id", "shingles"])

    return texts.select("id", F.col("text").cast("string").alias("text")).mapInArrow(of, f"id {kind}, shingles binary")


def sizes_allow(similar: int, one: str = "n_a", two: str = "n_b") -> Column:
    """Whether sets of these sizes can be linked at all."""
    return F.least(one, two) * 100 >= F.greatest(one, two) * similar


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (a, b, both, either): how many shingles both sets of each pair have, and either has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = [], []
            for one, two in zip(batch.column(2), batch.column(3), strict=True):
                own, found = (np.frombuffer(x.as_buffer(), np.uint64) for x in (one, two))
                n = len(np.intersect1d(own, found, assume_unique=True))
                both.append(n)
                either.append(len(own) + len(found) - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], names=["a", "b", "both", "either"])

    kind = sets.schema["id"].dataType.simpleString()
    one, two = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"shingles_{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(of, f"a {kind}, b {kind}, both long, either long")


def counted_shingles(sets: DataFrame) -> np.ndarray:
    """How often shingles come, by the last bits of their hashes: a sketch of MOST_COUNTS numbers at most."""
    total = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    n_counts = min(MOST_COUNTS, max(LEAST_COUNTS, 1 << (total // 16).bit_length()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_counts, np.int64)
        for batch in batches:
            for start, length in text_slices(batch.column(0), TEXT_BYTES):
                flat = np.frombuffer(b"".join(batch.column(0).slice(start, length).to_pylist()), np.uint64)
                np.add.at(counts, (flat & np.uint64(n_counts - 1)).astype(np.int64), 1)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["place", "n"])

    found = sets.select("shingles").mapInArrow(of, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_counts, np.int64)
    counts[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return counts


def rarest(sets: DataFrame, similar: int) -> DataFrame:
    """Rows (id, n, shingle): of each set the rarest shingles, of which two linked sets share one."""
    kind = sets.schema["id"].dataType.simpleString()
    counts = sets.sparkSession.sparkContext.broadcast(counted_shingles(sets))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how_often = counts.value
        for batch in batches:
            for start, length in text_slices(batch.column(1), TEXT_BYTES):
                part = batch.slice(start, length)
                found, sizes = [], []
                for x in part.column(1):
                    own = np.frombuffer(x.as_buffer(), np.uint64)
                    first = len(own) - -(-similar * len(own) // 100) + 1
                    order = np.lexsort((own, how_often[(own & np.uint64(len(how_often) - 1)).astype(np.int64)]))
                    found.append(own[order[:first]])
                    sizes.append(len(own))
                of_row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of_row)), pa.array(np.array(sizes, np.int64)[of_row], pa.int64()), pa.array(np.concatenate(found).astype(np.int64), pa.int64())], names=["id", "n", "shingle"])

    return sets.select("id", "shingles").mapInArrow(of, f"id {kind}, n long, shingle long")


def in_blocks(queries: DataFrame, members: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) between queries and members, both rows (doc_id, component, n), of the same component's number.

    Only sizes that allow a link meet: sets fall into classes of sizes, each up to 100 / similar times the one before, and those of a class meet
    with their own and the neighbouring ones. Both sides of a component and class are cut into blocks of about BLOCK rows by a hash of the id; a task compares one block with
    one other, and only links leave it. So no pair is ever a row, and no group is larger than two blocks.
    """
    kind = sets.schema["id"].dataType.simpleString()
    by = ["component", "class"]
    step = math.log(100 / similar) if similar < 100 else 1.0
    of_size = F.floor(F.log("n") / step + 1e-9).cast("int")
    queries = queries.select("doc_id", "component", of_size.alias("class"))
    members = members.select("doc_id", "component", F.explode(F.array(of_size - 1, of_size, of_size + 1)).alias("class"))
    blocks = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    counts = checkpointed(blocks(queries, "n_left").join(blocks(members, "n_right"), by))
    block = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(counts, by).select(*by, "doc_id", block("n_left").alias("i"), every("n_right").alias("j"))
    right = members.join(counts, by).select(*by, "doc_id", every("n_left").alias("i"), block("n_right").alias("j"))
    named = sets.withColumnRenamed("id", "doc_id")

    def of(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(one) and len(two):
            all_sets = [np.frombuffer(t, np.uint64) for t in two.shingles]
            sizes = np.array([len(x) for x in all_sets])
            ends, flat = np.cumsum(sizes), np.concatenate(all_sets)
            for a, own in zip(one.doc_id, (np.frombuffer(t, np.uint64) for t in one.shingles), strict=True):
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                total = np.concatenate([[0], np.cumsum(own[at] == flat)])
                both = total[ends] - total[ends - sizes]
                found += [(max(a, b), min(a, b)) for b in two.doc_id[both * 100 >= (len(own) + sizes - both) * similar] if a != b]
        return pd.DataFrame(found, columns=["a", "b"])

    keys_ = [*by, "i", "j"]
    columns = ["doc_id", *keys_, "shingles"]
    left, right = (df.join(named, "doc_id").select(columns).toDF(*columns).groupBy(*keys_) for df in (left, right))
    return left.cogroup(right).applyInPandas(of, f"a {kind}, b {kind}").distinct()


def sharing(placed: DataFrame, leads: DataFrame, tested: DataFrame, sets: DataFrame, similar: int) -> tuple[DataFrame, DataFrame]:
    """What still has to be compared of still_open(): pairs (a, b), and links (a, b) of those that share a shingle with too many."""
    ids = checkpointed(placed.select(F.col("doc_id").alias("id"), "component").distinct())
    rare = checkpointed(rarest(within(ids.select("id"), sets.withColumnRenamed("id", "own"), "own").withColumnRenamed("own", "id"), similar).join(if_few(ids), "id"))
    held = rare.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("one"), F.max("component").alias("other")).filter("one < other").select("shingle", "k")
    held = checkpointed(held)
    few = rare.join(held.filter(F.col("k") <= MOST_SHARED).select("shingle"), "shingle")
    one, two = (few.select("shingle", F.col("id").alias(c), F.col("component").alias(f"component_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    pairs = one.join(two, "shingle").filter("a > b and component_a <> component_b").filter(sizes_allow(similar)).select("a", "b").distinct()
    pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    bands = leads.select("doc_id", "first", "second")
    for c in "ab":
        pairs = pairs.join(bands.select(F.col("doc_id").alias(c), F.col("first").alias(f"first_{c}"), F.col("second").alias(f"second_{c}")), c)
    pairs = pairs.filter(F.arrays_overlap("first_a", "first_b") & F.arrays_overlap("second_a", "second_b")).select("a", "b")
    many = held.filter(F.col("k") > MOST_SHARED).select("shingle")
    if many.isEmpty():
        return pairs, pairs.limit(0)
    hot = checkpointed(rare.join(many, "shingle", "left_semi").select(F.col("id").alias("doc_id"), "n").distinct())
    there = placed.select("doc_id", "component", "largest").distinct().join(hot, "doc_id")
    queries = checkpointed(there.filter("component <> largest").select("doc_id", F.col("largest").alias("component"), "n").distinct())
    members = checkpointed(there.select("doc_id", F.col("largest").alias("component"), "n").distinct())
    return pairs, in_blocks(queries, members, sets, similar)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From links (u, v), rows (id, component): the smallest id of those that each is connected with by links of this task."""
    up: dict = {}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            p, q = root(up.setdefault(u, u)), root(up.setdefault(v, v))
            up[max(p, q)] = min(p, q)
        kind = batch.schema.types[0]
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([root(x) for x in up], kind)], names=["id", "component"])


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for all ids in links (a, b): the smallest id of those that each is connected with.

    Up to LINKS_OF_TASK links are counted and then solved in one task. More alternate
    two steps until every component is a star around its smallest id: each node passes its
    smallest neighbour on to its larger neighbours, then to its smaller ones. The rounds needed grow with the
    logarithm of a component's size; each is cut off from those before it by a checkpoint. Steps run in as many
    tasks as the links are worth.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    n_links = edges.count()
    if n_links <= LINKS_OF_TASK:
        kind = edges.schema["u"].dataType.simpleString()
        return checkpointed(edges.coalesce(1).mapInArrow(forest, f"id {kind}, component {kind}"))
    tasks = 1 + n_links // LINKS_OF_TASK
    edges = edges.coalesce(tasks)
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")
        edges = checkpointed(small.unionAll(least.select("u", F.col("least").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def still_open(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (key, doc_id, n) of buckets with several components, with component and the bucket's largest one."""
    placed = members.join(known.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    placed = checkpointed(placed)
    held = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"))
    several = held.groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("largest"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    return checkpointed(placed.join(several, "key"))


def near_duplicates(docs: DataFrame, size: int = 5, similar: int = SIMILAR, id_column: str = "doc_id", text_column: str = "text", halves: int = HALVES, rows: int = ROWS, seed: int = 11, report: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of docs.

    Two texts are linked if the sets of their runs of `size` words (A to Z lower-cased) have similar percent
    of their union in common. component_id is the smallest id reachable by links; kept marks the rows whose
    own id that is. A null or empty text, or one without words, has no shingles and is linked with nothing.
    Rows of one id belong to one component. A row of a null id is linked with nothing, has a null
    component_id and is kept. An empty table gives an empty result. Other columns are not carried.
    """
    signs = checkpointed(signed(docs, id_column, text_column, size, halves, rows, seed))
    of_set = ["set_1", "set_2", "n_shingles"]
    with_set = signs.filter("n_shingles > 0 and doc_id is not null")
    classes = with_set.groupBy(*of_set).agg(F.min("doc_id").alias("lead"))
    # first and second are functions of the set; so the lead's are the class's.
    leads = with_set.join(classes.withColumnRenamed("lead", "doc_id"), [*of_set, "doc_id"]).dropDuplicates([*of_set, "doc_id"])

    # Plans are kept short by checkpoints: each exchange of a long one costs the driver threads and memory.
    leads = checkpointed(leads.select("doc_id", F.col("n_shingles").alias("n"), "first", "second"))
    own_keys = keys(leads, halves)
    buckets = own_keys.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("lead"), F.max("doc_id").alias("last")).filter("lead.doc_id < last").select("key", F.col("lead.doc_id").alias("lead"), F.col("lead.n").alias("n_lead"))
    at = work_dir(docs.sparkSession, "minhash")
    own_keys.join(buckets, "key").select("key", "doc_id", "n", "lead", "n_lead").write.parquet(f"{at}/members")
    members = docs.sparkSession.read.parquet(f"{at}/members")

    ids = members.select(F.col("doc_id").alias("id")).distinct()
    named = docs.select(F.col(id_column).alias("own"), F.col(text_column).alias("text"))
    met = within(checkpointed(ids), named, "own").withColumnRenamed("own", "id")
    sets_of(met, size).write.parquet(f"{at}/sets")
    sets = docs.sparkSession.read.parquet(f"{at}/sets")

    first_pairs = members.filter("doc_id <> lead").filter(sizes_allow(similar, "n", "n_lead")).select(F.col("doc_id").alias("a"), F.col("lead").alias("b")).distinct()
    first = checkpointed(compared(first_pairs, sets))
    linked = F.col("both") * 100 >= F.col("either") * similar

    # What is left: members of one bucket in different components, neither of them its lead.
    others = checkpointed(members.filter("doc_id <> lead").select("key", "doc_id", "n"))
    tested, stars = first, components(first.filter(linked).select("a", "b"))
    for turn in range(PIVOT_TURNS):
        placed = still_open(others, stars)
        # Each member outside the bucket's largest component is compared with one member of that, another one in each bucket.
        pivots = placed.filter("component = largest").groupBy("key").agg(F.min_by(F.struct("doc_id", "n"), F.xxhash64(F.lit(turn), "key", "doc_id")).alias("pivot"))
        pairs = placed.filter("component <> largest").join(pivots, "key").filter(sizes_allow(similar, "n", "pivot.n")).select(F.greatest("doc_id", "pivot.doc_id").alias("a"), F.least("doc_id", "pivot.doc_id").alias("b")).distinct()
        more = checkpointed(compared(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets))
        tested, stars = tested.unionAll(more), components(stars.toDF("a", "b").unionAll(more.filter(linked).select("a", "b")))

    # Then those that share a bucket and a rare shingle.
    placed = still_open(others, stars)
    pairs, second = sharing(placed, leads, tested, sets, similar)
    more = checkpointed(compared(pairs, sets))
    second = checkpointed(more.filter(linked).select("a", "b").unionAll(second))
    if report:
        for name, df in (("classes", classes), ("members", members), ("sets", sets), ("first", first), ("tested", tested), ("linked", tested.filter(linked)), ("open members", placed), ("pairs of rare shingles", more), ("linked at last", second)):
            report(name, df)

    links = stars.toDF("a", "b").unionAll(second)
    of_class = classes.join(components(links).withColumnRenamed("id", "lead"), "lead", "left").select(*of_set, F.coalesce("component", "lead").alias("component"))
    # An id may have rows of several sets: their components are one.
    of_class = if_few(checkpointed(of_class))
    of_id = checkpointed(with_set.join(of_class, of_set).groupBy("doc_id").agg(F.min("component").alias("component"), F.max("component").alias("other")))
    joined = of_id.filter("component < other")
    if not joined.isEmpty():
        merged = components(with_set.join(of_class, of_set).join(joined.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component").alias("b")).unionAll(links).unionAll(with_set.join(classes, of_set).select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))))
        of_id = of_id.select("doc_id").join(merged.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    result = signs.select("doc_id", "n_shingles").join(of_id.select("doc_id", "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def missed_below(similarity: float, halves: int = HALVES, rows: int = ROWS) -> float:
    """A bound of the chance that two sets of a similarity share no key."""
    return min(1.0, 2 * math.pow(1 - similarity**rows, halves))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep. Rows of a null id stay."""
    gone = free_name(docs, "_gone_id")
    dropped = near_duplicates(docs, id_column=id_column, **options).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(if_few(checkpointed(dropped)), F.col(id_column) == F.col(gone), "left_anti")
