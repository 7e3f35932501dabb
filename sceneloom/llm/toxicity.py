"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, one of toxic and one of ordinary documents, are interpolated
Kneser-Ney models of order ORDER: the longest n-grams count the documents that have the word, shorter
ones the letters that stand before them. The lowest orders, letter pairs and letters, are
shared by both models and counted over all documents; so an expression that neither class knows is
backed off to the same chances, and says nothing, and a rare one says what its known parts say.
A toxic document is one in which a share of the words is drawn from the toxic model. A document's
value is the difference of its log-likelihoods, toxic and ordinary, divided by its number of words. A
logistic curve makes a score of it; it is fitted on the labelled documents, each valued by models that
were learned from the other parts of them.

Labels are learned from SAMPLE_ROWS labelled rows at most, chosen by a hash of the id. All else covers all
data: tasks count the n-grams of all documents, the counts are added up and the chances are computed in
tables. Documents are read twice, to count and to value. The table of n-grams is broadcast if it is
counted to have MOST_GRAMS rows at most; a larger one values the distinct words by a join with their
n-grams, and the documents by a join with their words. Both ways give the same values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import checkpointed, text_slices, without, work_dir

#: Letters of the longest n-gram, and of the longest that both classes share.
ORDER, SHARED = 4, 2
#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 40_000
#: Of FOLDS parts of the ids, part 0 is held out, the others are learned from.
FOLDS, HELD_OUT = 5, 0
LEARNED = [k for k in range(FOLDS) if k != HELD_OUT]
#: The groups of the sample, a part and a label each, and the models: without each part in turn, and of all of it.
GROUPS, MODELS = 2 * len(LEARNED), len(LEARNED) + 1
DISCOUNT = 0.75
#: The share of words of a toxic document that are taken to be of the toxic model; the others are ordinary in either class.
TOXIC_SHARE = 0.02
#: Values go through asinh(STRETCH * value) before the logistic curve, so that a few extreme ones don't flatten it.
STRETCH = 200.0
#: n-grams that are broadcast at most, of 8 bytes and 8 for each model.
MOST_GRAMS = 1_000_000
#: n-grams that a task adds up before it hands them on, and bytes of text that it takes at a time.
ADDED_UP, TEXT_BYTES = 200_000, 2 << 20
#: What stands before and after each word.
BEGIN, END = "\x02", "\x03"
#: Letters have numbers of 16 bits in a task; four make the key of an n-gram.
MOST_LETTERS = 1 << 16


def fold(id_column: Column) -> Column:
    """The part of the ids that an id is in: the CRC-32 of its digits, modulo FOLDS. A null id is in none."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


class Words:
    """The words of some texts, runs of letters in lower case: the distinct ones, and of each occurrence its text and its number."""

    def __init__(self, texts: pa.Array):
        lines = pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), r"[^\p{L} ]+", " ")
        split = pc.ascii_split_whitespace(lines)
        numbered = split.flatten().dictionary_encode()
        self.words = numbered.dictionary.to_pylist()
        self.number = numbered.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
        if "" in self.words:  # what stands before a first space is no word
            real = self.number != self.words.index("")
            self.number, self.text = self.number[real], self.text[real]
        self.n_texts = len(texts)

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """The code points of all distinct words, each between BEGIN and END, and the word of each."""
        points = np.frombuffer(f"{BEGIN}{f'{END}{BEGIN}'.join(self.words)}{END}".encode("utf-32-le"), "<u4") if self.words else np.empty(0, "<u4")
        return points, np.cumsum(points == ord(BEGIN)) - 1


class Alphabet:
    """Numbers of letters, from 1, in the order in which they come; 0 for those without."""

    def __init__(self):
        self.points = [0]
        self.number = np.zeros(0x110000, np.uint64)

    def learn(self, points: np.ndarray) -> None:
        for point in np.unique(points[self.number[points] == 0]):
            self.number[point] = len(self.points)
            self.points.append(point)

    def pairs(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        own = self.number[points]
        return own[ends - 1] << np.uint64(16) | own[ends]

    def longest(self, points: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the n-grams that end at each letter but the first two of a line, of ORDER letters or of all before; and their words."""
        own = self.number[points]
        ends = np.flatnonzero(word[2:] == word[:-2]) + 2
        fourth = np.zeros(len(ends), np.uint64)
        far = np.flatnonzero(ends > 2)
        far = far[word[ends[far] - 3] == word[ends[far]]]
        fourth[far] = own[ends[far] - 3]
        return fourth << np.uint64(48) | own[ends - 2] << np.uint64(32) | own[ends - 1] << np.uint64(16) | own[ends], word[ends]

    def keys(self, grams: list[str]) -> np.ndarray:
        """The keys of n-grams whose letters all have numbers."""
        points = np.frombuffer("".join(g.rjust(ORDER, "\0") for g in grams).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
        parts = self.number[points]
        return parts[:, 0] << np.uint64(48) | parts[:, 1] << np.uint64(32) | parts[:, 2] << np.uint64(16) | parts[:, 3]

    def grams(self, keys: np.ndarray) -> pa.Array:
        numbers = np.array(self.points, "<u4")[np.stack([keys >> np.uint64(s) & np.uint64(0xFFFF) for s in (48, 32, 16, 0)], axis=1).astype(np.int64)]
        text = numbers.tobytes().decode("utf-32-le")
        return pa.array([text[i : i + ORDER].lstrip("\0") for i in range(0, len(text), ORDER)], pa.string())


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their rows of counts."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    return ordered[first], np.add.reduceat(counts[order], first, axis=0) if len(first) else counts[:0]


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows (gram, n, c0, ...), from docs of text and group, a number below GROUPS or null.

    Of letter pairs n, and of all longer n-grams of Alphabet.longest c by group, is in how many documents a
    word is that holds them, each time it does. Tasks add up before anything is shuffled.
    """
    names = ["n", *(f"c{k}" for k in range(GROUPS))]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def handed_on() -> pa.RecordBatch:
            keys, counts = added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])) if held else (np.empty(0, np.uint64), np.empty((0, len(names)), np.int32))
            return pa.RecordBatch.from_arrays([alphabet.grams(keys), *(pa.array(c.astype(np.int64)) for c in counts.T)], names=["gram", *names])

        for batch in batches:
            groups = batch.column(1).fill_null(GROUPS).to_numpy(zero_copy_only=False)
            for start, n in text_slices(batch.column(0), TEXT_BYTES):
                own, group = Words(batch.column(0).slice(start, n)), groups[start : start + n]
                points, word = own.letters()
                if len(alphabet.points) + len(np.unique(points)) > MOST_LETTERS:
                    yield handed_on()
                    alphabet, held = Alphabet(), []
                alphabet.learn(points)
                # In how many texts each word is, of each group and of all.
                once = np.unique(own.text * len(own.words) + own.number)
                text, number = np.divmod(once, max(1, len(own.words)))
                n_words = np.bincount(number, minlength=len(own.words))
                of_group = np.bincount(number * (GROUPS + 1) + group[text], minlength=len(own.words) * (GROUPS + 1)).reshape(-1, GROUPS + 1)[:, :GROUPS]
                ends = np.flatnonzero(word[1:] == word[:-1]) + 1
                keys, at = np.unique(alphabet.pairs(points, ends), return_inverse=True)
                counts = np.zeros((len(keys), len(names)), np.int32)  # documents of one task
                counts[:, 0] = np.bincount(at, n_words[word[ends]], len(keys))
                held.append((keys, counts))
                keys, of_word = alphabet.longest(points, word)
                keys, at = np.unique(keys, return_inverse=True)
                counts = np.zeros((len(keys), len(names)), np.int32)  # documents of one task
                known = np.flatnonzero(of_group.any(axis=1)[of_word])
                for k in range(GROUPS):
                    counts[:, k + 1] = np.bincount(at[known], of_group[of_word[known], k], len(keys))
                held.append((keys, counts))
                if sum(len(k) for k, _ in held) >= ADDED_UP:
                    held = [added(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                    if len(held[0][0]) >= ADDED_UP // 2:
                        yield handed_on()
                        held = []
        yield handed_on()

    counted = docs.select("text", "group").mapInArrow(of, ", ".join(["gram string", *(f"{c} long" for c in names)]))
    return counted.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names])


def mixed(count: Column, total: Column, kinds: Column, lower: Column) -> Column:
    """The chance of a letter after a context of that many letters and kinds; the lower one after a context that is not known."""
    return F.when(total > 0, (F.greatest(count - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * lower) / total).otherwise(lower)


def gram_ratios(counted: DataFrame) -> DataFrame:
    """From gram_counts(), rows (gram, r0, ...): how much likelier the last letter of each n-gram is in toxic documents, as a logarithm.

    The ratios are those of the models of all parts of LEARNED but one, in their order, and of the whole sample.
    """
    names = [f"c{k}" for k in range(GROUPS)]
    models = range(MODELS)
    own = [(y, m) for y in (0, 1) for m in models]
    count = lambda y, m: sum((F.col(c) for c in names[y::2]), F.lit(0)) - (F.col(names[2 * m + y]) if m < len(LEARNED) else F.lit(0))
    kinds_of = lambda c: F.sum((F.col(c) > 0).cast("long"))
    before = lambda n: Window.partitionBy(F.substring("gram", 1, n))

    # Letters and pairs are shared: all documents count.
    pairs = counted.filter(F.length("gram") == SHARED).select("gram", "n")
    letter = F.substring("gram", SHARED, 1)
    pairs = checkpointed(pairs.select("*", kinds_of("n").over(Window.partitionBy(letter)).alias("letters"), F.sum("n").over(before(1)).alias("total"), kinds_of("n").over(before(1)).alias("kinds")))
    n_pairs, n_letters = pairs.filter("n > 0").agg(F.count(F.lit(1)), F.count_distinct(letter)).first()
    lowest = (F.col("letters") + 0.5) / (n_pairs + 0.5 * (n_letters + 1))
    pairs = pairs.select(F.col("gram").alias("pair"), mixed(F.col("n"), F.col("total"), F.col("kinds"), lowest).alias("p2"))

    # The longest n-grams count documents of the class; those of three letters the letters before them, or documents at the start of a word.
    longest = counted.filter(F.length("gram") > SHARED).select("gram", *[count(y, m).alias(f"n{y}_{m}") for y, m in own])
    four, short = F.length("gram") == ORDER, F.length("gram") == ORDER - 1
    three = longest.filter(four | short).select(F.substring("gram", -(ORDER - 1), ORDER - 1).alias("gram"), *[F.when(four, (F.col(f"n{y}_{m}") > 0).cast("long")).otherwise(F.col(f"n{y}_{m}")).alias(f"n{y}_{m}") for y, m in own])
    three = three.groupBy("gram").agg(*[F.sum(f"n{y}_{m}").alias(f"n{y}_{m}") for y, m in own])

    def known(grams: DataFrame, n: int, lower: DataFrame, on: str, below, name: str) -> DataFrame:
        """grams of n letters with their chances, from those of the n-grams a letter shorter."""
        sums = [c for y, m in own for c in (F.sum(f"n{y}_{m}").over(before(n - 1)).alias(f"t{y}_{m}"), kinds_of(f"n{y}_{m}").over(before(n - 1)).alias(f"k{y}_{m}"))]
        grams = grams.select("*", F.substring("gram", -(n - 1), n - 1).alias(on), *sums).join(lower, on)
        return grams.select("gram", *[mixed(F.col(f"n{y}_{m}"), F.col(f"t{y}_{m}"), F.col(f"k{y}_{m}"), F.col(below(y, m))).alias(f"{name}{y}_{m}") for y, m in own])

    ratio = lambda name: [F.log(F.col(f"{name}1_{m}") / F.col(f"{name}0_{m}")).alias(f"r{m}") for m in models]
    three = checkpointed(known(three, ORDER - 1, pairs, "pair", lambda y, m: "p2", "p3_"))
    fours = known(longest.filter(four), ORDER, three.withColumnRenamed("gram", "triple"), "triple", lambda y, m: f"p3_{y}_{m}", "p4_")
    # Words begin with an n-gram of three letters; longer ones end with the context of all that stands before.
    return fours.select("gram", *ratio("p4_")).unionByName(three.filter(F.col("gram").startswith(BEGIN)).select("gram", *ratio("p3_")))


class Ratios:
    """The rows of gram_ratios(), in a table and, if that is small, in memory: keys in order, and a row for each model."""

    def __init__(self, table: DataFrame):
        self.table, self.sent = table, None
        if table.count() <= MOST_GRAMS:
            found = table.toArrow()  # MOST_GRAMS rows at most
            grams = found.column("gram").to_pylist()
            if len(set().union(*grams)) < MOST_LETTERS:
                ratios = np.stack([found.column(f"r{m}").to_numpy() for m in range(MODELS)], axis=1)
                self.sent = table.sparkSession.sparkContext.broadcast((grams, ratios))


class Lookup:
    """Values words by broadcast n-grams."""

    def __init__(self, grams: list[str], ratios: np.ndarray):
        self.alphabet = Alphabet()
        self.alphabet.learn(np.frombuffer("".join(grams).encode("utf-32-le"), "<u4"))
        keys = self.alphabet.keys(grams)
        order = np.argsort(keys)
        self.keys, self.ratios = keys[order], np.concatenate([ratios[order], np.zeros((1, MODELS))])

    def word_values(self, own: Words) -> np.ndarray:
        """A row for each distinct word, a column for each model."""
        points, word = own.letters()
        keys, of_word = self.alphabet.longest(points, word)
        keys, at = np.unique(keys, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        place = np.where(self.keys[place] == keys, place, len(self.keys)) if len(self.keys) else np.zeros(len(keys), np.int64)
        found = self.ratios[place]
        sums = np.stack([np.bincount(of_word, found[at, m], len(own.words)) for m in range(MODELS)], axis=1)
        return np.log1p(TOXIC_SHARE * np.expm1(np.minimum(sums, 50.0)))


def word_values(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """Rows (word, v): the values of all distinct words of docs, by joins; v has one for each model. They are in files."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in text_slices(batch.column(0), TEXT_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array([w for w in Words(batch.column(0).slice(start, n)).words if w], pa.string())], names=["word"])

    words = docs.select("text").mapInArrow(of, "word string").distinct()
    line = F.concat(F.lit(BEGIN), "word", F.lit(END))
    grams = F.transform(F.sequence(F.lit(3), F.length(line)), lambda i: F.substring(line, F.greatest(i - ORDER + 1, F.lit(1)), F.least(i, F.lit(ORDER))))
    held = words.select("word", F.explode(grams).alias("gram")).join(ratios, "gram", "left")
    sums = held.groupBy("word").agg(*[F.coalesce(F.sum(f"r{m}"), F.lit(0.0)).alias(f"r{m}") for m in range(MODELS)])
    value = F.array(*[F.log1p(TOXIC_SHARE * F.expm1(F.least(F.col(f"r{m}"), F.lit(50.0)))) for m in range(MODELS)])
    at = work_dir(docs.sparkSession, "toxic-words")
    sums.select("word", value.alias("v")).write.parquet(at)
    return docs.sparkSession.read.parquet(at)


def values(docs: DataFrame, ratios: Ratios) -> DataFrame:
    """docs (doc_id, tie, y, part, text) with value and rest instead of text: the mean of its words, 0 without words.

    value is by the model of the whole sample, rest by that without the part of the column part, null where that is null.
    Each row of docs has its own row.
    """
    kept = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in kept]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    sent = ratios.sent

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(*sent.value)
        for batch in batches:
            parts = batch.column(batch.schema.names.index("part")).fill_null(MODELS - 1).to_numpy(zero_copy_only=False)
            for start, n in text_slices(batch.column(len(kept)), TEXT_BYTES):
                own = Words(batch.column(len(kept)).slice(start, n))
                of_words = lookup.word_values(own)
                n_words = np.maximum(np.bincount(own.text, minlength=n), 1)
                mean = lambda column: np.bincount(own.text, column, n) / n_words  # noqa: B023, E731
                value, part = mean(of_words[own.number, MODELS - 1]), parts[start : start + n]
                rest = mean(of_words[own.number, part[own.text]])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, n) for k in range(len(kept))), pa.array(value), pa.array(rest, mask=part == MODELS - 1)], names=[*names, "value", "rest"])

    if sent is not None:
        return docs.select(*names, "text").mapInArrow(valued, f"{types}, value double, rest double")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in text_slices(batch.column(len(kept) + 1), TEXT_BYTES):
                own = Words(batch.column(len(kept) + 1).slice(start, n))
                both, times = np.unique(own.text * len(own.words) + own.number, return_counts=True)
                text, number = np.divmod(both, max(1, len(own.words)))
                empty = np.setdiff1d(np.arange(n), text)
                rows = batch.slice(start, n).select([*names, "_row"]).take(pa.array(np.concatenate([text, empty])))
                word = pa.array(own.words, pa.string()).take(pa.array(number))
                columns = [pa.concat_arrays([word, pa.nulls(len(empty), pa.string())]), pa.array(np.concatenate([times, np.zeros(len(empty), np.int64)]), pa.int64())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*names, "_row", "word", "n"])

    held = docs.select(*names, F.monotonically_increasing_id().alias("_row"), "text").mapInArrow(counted, f"{types}, _row long, word string, n long")
    held = held.join(word_values(docs, ratios.table), "word", "left").groupBy("_row", *names)
    mean = lambda model: F.coalesce(F.sum(F.element_at("v", model + 1) * F.col("n")) / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0))
    return held.agg(mean(F.lit(MODELS - 1)).alias("value"), F.when(F.col("part").isNotNull(), mean(F.col("part"))).alias("rest")).select(*names, "value", "rest")


def logistic(points: list[tuple[float, int]]) -> tuple[float, float]:
    """Slope and offset of the curve through (value, label), with a weak pull of the slope to 0, by Newton's steps."""
    mean = sum(x for x, _ in points) / max(1, len(points))
    spread = math.sqrt(sum((x - mean) ** 2 for x, _ in points) / max(1, len(points))) or 1.0
    share = (sum(y for _, y in points) + 0.5) / (len(points) + 1)
    slope, offset, pull = 0.0, math.log(share / (1 - share)), 0.01
    for _ in range(60):
        g0 = g1 = h01 = 0.0
        h00, h11 = 1e-9, pull
        for x, y in points:
            z = (x - mean) / spread
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, slope * z + offset))))
            w = p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + y - p, g1 + (y - p) * z, h00 + w, h01 + w * z, h11 + w * z * z
        g1 -= pull * slope
        det = h00 * h11 - h01 * h01
        step0, step1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        most = max(1.0, abs(step0) / 4, abs(step1) / 4)
        offset, slope = offset + step0 / most, slope + step1 / most
        if abs(step0) + abs(step1) < 1e-8:
            break
    slope = max(slope, 0.0)
    return slope / spread, offset - slope * mean / spread


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """The rows of score(), with tie, a hash of the text."""
    own = lambda df: df.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("tie"), F.col(text_column).cast("string").alias("text"))
    learned = own(docs if learn_from is None else learn_from)
    known = labels.filter(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    sample = checkpointed(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS))
    part = F.array_position(F.array(*map(F.lit, LEARNED)), fold(F.col("doc_id"))) - 1
    sample = F.broadcast(sample.select("doc_id", "y", part.cast("int").alias("part")))  # SAMPLE_ROWS rows of three numbers at most
    marked = learned.join(sample, "doc_id", "left").select("doc_id", "tie", "y", "part", "text")
    grouped = marked.select("text", (2 * F.col("part") + F.col("y")).alias("group"))
    unmarked = own(docs).select("doc_id", "tie", F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("part"), "text")
    if learn_from is None:
        counted = gram_counts(grouped)
    else:  # nothing is learned from the others, but their n-grams have chances too
        others = gram_counts(unmarked.select("text", F.col("part").alias("group")))
        others = others.select("gram", *[F.lit(0).cast("long").alias(c) for c in others.columns[1:]])
        both = gram_counts(grouped).unionByName(others)
        counted = both.groupBy("gram").agg(*[F.sum(c).alias(c) for c in both.columns[1:]])
    spark, at = docs.sparkSession, work_dir(docs.sparkSession, "toxic-grams")
    gram_ratios(checkpointed(counted)).write.parquet(at)
    ratios = Ratios(spark.read.parquet(at))
    # What is learned from is mostly what is scored, and then its words are looked up once.
    valued = checkpointed(values(marked if learn_from is None else marked.filter("y IS NOT NULL"), ratios))
    points = valued.filter("y IS NOT NULL").groupBy("doc_id").agg(F.min("rest").alias("rest"), F.max("y").alias("y")).orderBy("doc_id").collect()  # SAMPLE_ROWS points at most
    slope, offset = logistic([(math.asinh(STRETCH * r.rest), r.y) for r in points])
    found = valued if learn_from is None else values(unmarked, ratios)
    result = 1 / (1 + F.exp(-(F.asinh(F.col("value") * STRETCH) * slope + offset)))
    return found.select("doc_id", "tie", (F.coalesce(fold(F.col("doc_id")), F.lit(-1)) == HELD_OUT).alias("held_out"), result.alias("score"), (result >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", learn_from: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs, repeated ids included.

    labels has doc_id and toxic; labels of one id that differ count as toxic, null ones not at all. Of rows of one labelled id the least toxic
    calibrates. The
    models are learned from the documents of learn_from, which is docs if not given. score is from 0 to 1,
    predicted is 1 from 0.5 on. A null or empty text, or one without letters, has the value 0 and the
    score that goes with it. A null id is not held out. Without labels of both classes nothing is known:
    scores are all the share of toxic labels, or a half without labels. Other columns are not carried.
    """
    return scored(docs, labels, id_column, text_column, learn_from).drop("tie")


def reject_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without the rows predicted toxic. Each row stands or falls by its own text, whether its id is repeated, null or neither."""
    return without(docs, scored(docs, labels, id_column, text_column).filter("predicted = 1"), id_column, text_column)
